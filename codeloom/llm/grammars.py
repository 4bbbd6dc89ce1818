"""Lexers, bracket readings and grammars of the supported languages (see ``gll.py`` for the notation)."""

from __future__ import annotations

import re

from codeloom.llm.gll import Grammar

STR, TPL, INC, ASG, CMP, ARR, ELL, COL2, LIFE = (chr(0xE000 + i) for i in range(1, 10))
POW, BROKEN = "\ue0f0", "\ue0f1"
RET, CHN, DEF, RNG, OR2, AND2 = (chr(0xE010 + i) for i in range(6))
BASE = {"NAME": "a", "POW": POW, "NUM": "0", "STR": STR, "TPL": TPL, "INC": INC, "ASG": ASG, "CMP": CMP, "=>": ARR, "...": ELL, "::": COL2, "LIFE": LIFE, "->": RET, "<-": CHN, ":=": DEF, "..": RNG, "||": OR2, "&&": AND2}
_PAIR = {"(": ")", "[": "]", "{": "}"}
# A long run of equal literals parses as a short one does, in every language here.
_RUN = re.compile(f"((?:-?0|{STR}),)\n*(?:\\1\n*){{7,}}")
_BRACKET = re.compile(r"[(){}\[\]]")
_INNERMOST = re.compile(r"\(([^(){}\[\]]*)\)|\[([^(){}\[\]]*)\]|\{([^(){}\[\]]*)\}")
_SAME = re.compile(r"(?:e,){4,}")
_STRINGS = re.compile(STR + "{3,}")
#: So many levels are reduced level by level; deeper ones bracket by bracket, which takes time in proportion to the text at any depth.
LEVELS = 60
GROUP = "\U000f0000-\U000fffff"


class Language:
    """One language: a lexer to one-character tokens, a reducer of bracket groups, and a grammar."""

    pattern: re.Pattern
    ops: list[tuple[str, str]] = []
    keywords = ""
    drop = " \t\r\f\v\xa0\ufeff"

    def __init__(self, grammar: str):
        self.kw = {w: chr(0xE100 + i) for i, w in enumerate(self.keywords.split())}
        self.g = Grammar(grammar, {**BASE, **self.kw})
        self.readings = self.brackets()
        self.seen: dict[tuple[str, str], str | None] = {}

    # lexing
    def token(self, m: re.Match) -> str:
        raise NotImplementedError

    def shape(self, text: str) -> str:
        s = self.pattern.sub(self.token, text)
        for a, b in self.ops:
            if a in s:
                s = s.replace(a, b)
        for c in self.drop:
            if c in s:
                s = s.replace(c, "")
        return _RUN.sub(r"\1\1\1", _STRINGS.sub(STR + STR, s))

    # bracket groups
    def brackets(self) -> dict[str, list]:
        raise NotImplementedError

    def listing(self, nt: str, holes: bool = False, empty: bool = True, trailing: bool = True, whole: str | None = None):
        """Whether a bracket's content is a list of ``nt``, or derives ``whole``.

        Elements are recognised first, each becoming one token (equal ones once), then the list of these tokens by a production of its own.
        """
        g = self.g
        name = f"List{int(holes)}{int(empty)}{int(trailing)}"
        if name not in g.nts:
            one = "'e'?" if holes else "'e'"
            g.extend(f"{name} = {one} (',' {one})* {'' if holes or not trailing else chr(39) + ',' + chr(39) + '?'} {'|' if empty else ''} ;")

        def check(s: str) -> bool:
            s = s.replace("\n", "")
            parts = s.split(",")
            kinds = {p: "e" if p and g.derives(nt, p) else "?" if p else "" for p in set(parts)}
            # A list of many elements is one exactly if a list of four is.
            return g.derives(name, _SAME.sub("e,e,e,e,", ",".join(map(kinds.__getitem__, parts)))) or whole is not None and g.derives(whole, s)

        return check

    def whole(self, nt: str):
        return lambda s: self.g.derives(nt, s.replace("\n", ""))

    def pieces(self, nt: str, several: str | None = None):
        def check(s: str) -> bool:
            return all(self.g.derives(nt, p) or several is not None and self.g.derives(several, p) for p in set(self.split(s)))

        return check

    def split(self, s: str) -> list[str]:
        raise NotImplementedError

    def group(self, bracket: str, content: str) -> str | None:
        key = (bracket, content)
        if key in self.seen:
            return self.seen[key]
        mask = 0
        for name, check in self.readings[bracket]:
            if name in self.g.groups and check(content):
                mask |= 1 << self.g.groups[name]
        got = self.g.group_char(mask) if mask else None
        if len(content) < 2000:
            if len(self.seen) > 400_000:
                self.seen.clear()
            self.seen[key] = got
        return got

    def reduce(self, s: str) -> str | None:
        """The token string with every bracket group turned into one token, or None if a group is not valid."""
        broken = False

        def group(m: re.Match) -> str:
            nonlocal broken
            i = m.lastindex
            ch = self.group("([{"[i - 1], m[i])
            if ch is not None and i == 3 and self.arrows:
                k = m.start() - 1
                while k >= 0 and m.string[k] == "\n":
                    k -= 1
                ch = self.narrowed(m.string[k] if k >= 0 else "", ch)
            if ch is None:
                broken = True
                return ""
            return ch

        for _ in range(LEVELS):
            s, n = _INNERMOST.subn(group, s)
            if broken:
                return None
            if not n:
                return None if _BRACKET.search(s) else s
        return self.reduce_deep(s)

    def reduce_deep(self, s: str) -> str | None:
        out, opened, at = [[]], [], 0
        for m in _BRACKET.finditer(s):
            c = m.group()
            out[-1].append(s[at : m.start()])
            at = m.end()
            if c in "([{":
                opened.append(c)
                out.append([])
                continue
            if not opened or _PAIR[opened[-1]] != c:
                return None
            bracket = opened.pop()
            ch = self.group(bracket, "".join(out.pop()))
            if ch is not None and bracket == "{" and self.arrows:
                ch = self.narrowed(next((x.rstrip("\n")[-1] for x in reversed(out[-1]) if x.rstrip("\n")), ""), ch)
            if ch is None:
                return None
            out[-1].append(ch)
        if opened:
            return None
        out[0].append(s[at:])
        return "".join(out[0])

    arrows = False

    def narrowed(self, before: str, ch: str) -> str | None:
        """The token of a group of braces where the token before it leaves fewer readings (asked if ``arrows``)."""
        return ch

    def valid(self, text: str) -> bool:
        s = self.reduce(self.shape(text))
        return s is not None and self.accepts(s)

    def accepts(self, s: str) -> bool:
        raise NotImplementedError


_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_ID = r"[^\W\d][\w]*"
# A template literal with templates in its expressions, to a depth of four.
_TEMPLATE = r"`(?:[^`\\]|\\[\s\S])*+`"
for _ in range(4):
    _TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^`{}'\"/]|" + _DQ + "|" + _SQ + r"|/(?![*/])|/\*[\s\S]*?\*/|\{(?:[^`{}'\"]|" + _DQ + "|" + _SQ + r"|\{[^`{}]*\})*+\}|" + _TEMPLATE + r")*+\})*+`"
_NUM = r"0[xXbBoO][\da-fA-F_]+\w*|(?:\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[a-zA-Z]?\w*(?<![g-km-zG-KM-Z])"

JS_GRAMMAR = r"""
Id = NAME | 'of' | 'async' | 'get' | 'set' | 'static' | 'from' | 'as' | 'let' | 'type' | 'declare' | 'namespace' | 'abstract' | 'readonly' | 'is' | 'keyof' | 'infer' | 'satisfies' | 'asserts' | 'module' | 'interface' | 'private' | 'public' | 'protected' | 'implements' | 'override' | 'await' | 'yield' ;
AnyName = Id | Reserved ;
Reserved = 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export' | 'extends' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'null' | 'true' | 'false' | 'enum' ;
Expr = Assign (',' Assign)* ;
Assign = Arrow | Cond (('=' | ASG) Assign)? | 'yield' '*'? Assign? ;
Arrow = 'async'? (Id | %TP @Params %RT) '=>' (@Block | Assign) ;
Cond = Bin ('?' Assign ':' Assign)? ;
Bin = Un (BinOp Un %AS)* ;
BinOp = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | CMP | '<' | '>' | '<' '<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof' ;
Un = ('!' | '~' | '+' | '-' | INC | 'typeof' | 'void' | 'delete' | 'await') Un | Mem INC? %AS ;
Mem = Prim Suf* ;
Suf = '.' AnyName | '.'? @Index | '.'? @Args | TPL %SUF ;
Prim = Id | NUM | STR | TPL | 'this' | 'super' | 'null' | 'true' | 'false' | @Array | @Object | @Paren | 'async'? 'function' '*'? Id? %TP @Params %RT @Block | Class | 'new' ('.' Id | Mem) | 'import' (@Args | '.' Id) ;
Class = %DEC 'class' Id? %TP ('extends' Mem %TA)? %IMPL @ClassBody ;
ClassDecl = %DEC 'class' Id %TP ('extends' Mem %TA)? %IMPL @ClassBody ;
Binding = Id | @Array | @Object ;
Decl = Id %NN %ANN ('=' Assign)? | (@Array | @Object) %ANN '=' Assign ;
Const = Binding %ANN '=' Assign ;
Var = ('var' | 'let') Decl (',' Decl)* | 'const' Const (',' Const)* ;
End = ';' | $ ;
Stmt = @Block | Var End | 'async'? 'function' '*'? Id %TP @Params %RT @Block | ClassDecl | 'if' @Paren Stmt ('else' Stmt)? | 'for' 'await'? @ForHead Stmt | 'while' @Paren Stmt | 'do' Stmt 'while' @Paren ';'?
  | 'return' Expr? End | ('break' | 'continue') Id? End | 'throw' Expr End | 'try' @Block ('catch' @Params? @Block)? ('finally' @Block)? | 'switch' @Paren @SwitchBody | Id ':' Stmt | 'debugger' End | ';' | ![class function] Expr End %STMT ;
Seq = Stmt+ ;
Item = Stmt | Import | Export ;
Items = Item+ ;
Import = 'import' %TYPE (STR | ImpClause 'from' STR) (('with') @Object)? End ;
ImpClause = Id | @Names | '*' 'as' Id | Id ',' (@Names | '*' 'as' Id) ;
Export = 'export' ('default' ('async'? 'function' '*'? Id? %TP @Params %RT @Block | %ABS Class | Assign End) | Var End | 'async'? 'function' '*'? Id %TP @Params %RT @Block | ClassDecl | %TYPE @Names ('from' STR)? End | '*' ('as' AnyName)? 'from' STR End %EXP) ;
NameItem = %TYPE AnyName ('as' AnyName)? ;
Arg = Assign | '...' Assign ;
ArgList = Arg (',' Arg)* ','? ;
Elem = Assign | '...' Assign ;
PropName = AnyName | STR | NUM | @Index ;
Prop = PropName ':' Assign | Id ('=' Assign)? | '...' Assign | ('async' | 'get' | 'set' | '*')* PropName %TP @Params %RT @Block ;
Props = Prop (',' Prop)* ','? ;
Param = %DEC %MOD '...'? Binding %OPT %ANN ('=' Assign)? %THIS ;
ParamList = Param (',' Param)* ','? ;
ForHead = (Var | Expr)? ';' Expr? ';' Expr? | ('var' | 'let' | 'const')? Binding ('in' | 'of') Expr | Mem ('in' | 'of') Expr ;
Switch = (('case' Expr | 'default') ':' Seq?)* ;
Member = %DEC %MODS ('static' | 'async' | 'get' | 'set' | '*')* PropName %OPT %TP @Params %RT (@Block %NOBODY) | %DEC %MODS 'static'? PropName %OPT %NN %ANN ('=' Assign)? End | 'static' @Block | ';' %MEM ;
Members = Member+ ;
"""
_TS = {
    "%TP": "(TParams)?", "%RT": "(':' TypePred)?", "%AS": "(('as' | 'satisfies') (Type | 'const'))*", "%SUF": "| TArgs @Args | '!'", "%DEC": "('@' Mem)*", "%TA": "TArgs?", "%IMPL": "('implements' Type (',' Type)*)?",
    "%NN": "'!'?", "%ANN": "(':' Type)?", "%TYPE": "'type'?", "%MOD": "('public' | 'private' | 'protected' | 'readonly' | 'override')*", "%OPT": "'?'?", "%MODS": "('public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'static')*",
    "%ABS": "'abstract'?", "%THIS": "| 'this' ':' Type", "%NOBODY": "| End",
    "%STMT": "| Decls", "%EXP": "| Decls | '=' Expr End | 'as' 'namespace' Id End | 'import' Id '=' Expr End", "%MEM": "| ('public' | 'private' | 'protected' | 'readonly' | 'static')* @IndexSig ':' Type End",
}
_TS_ONLY = r"""
Decls = 'declare'? ('interface' Id TParams? ('extends' Type (',' Type)*)? @TObj | 'type' Id TParams? '=' Type End | 'const'? 'enum' Id @Enum | 'abstract' ClassDecl | ('namespace' | 'module') Id ('.' Id)* @Space) | 'declare' (AVar End | 'function' Id TParams? @Params (':' TypePred)? End | 'abstract'? ClassDecl | ('namespace' | 'module') (Id ('.' Id)* | STR) @Ambient | 'module' STR End | Id @Ambient) | 'function' Id TParams? @Params (':' TypePred)? End ;
AVar = ('var' | 'let' | 'const') Binding (':' Type)? ('=' Assign)? (',' Binding (':' Type)? ('=' Assign)?)* ;
Ambient = 'export'? 'default'? 'declare'? (AVar End | 'function' Id? TParams? @Params (':' TypePred)? End | 'abstract'? ClassDecl | ('namespace' | 'module') Id ('.' Id)* @Ambient | Decls) | Import | Export | ';' ;
TypePred = ('asserts')? (Id | 'this') 'is' Type | 'asserts' (Id | 'this') | Type ;
Type = TUnion ('extends' TUnion '?' Type ':' Type)? | TParams? @Params '=>' TypePred | 'abstract'? 'new' TParams? @Params '=>' Type ;
TUnion = ('|' | '&')? TPost (('|' | '&') TPost)* ;
TPost = ('keyof' | 'readonly' | 'infer' | 'unique') TPost | TPrim (@TIndex)* ;
TPrim = Id ('.' Id)* TArgs? | STR | '-'? NUM | 'null' | 'void' | 'this' | 'true' | 'false' | TPL | @TObj | @TTuple | @TParen | 'typeof' Mem TArgs? | 'import' @Args ('.' Id)* TArgs? ;
TArgs = '<' Type (',' Type)* ','? '>' ;
TParams = '<' TParam (',' TParam)* ','? '>' ;
TParam = 'const'? Id ('extends' Type)? ('=' Type)? ;
TElem = '...'? (Id '?'? ':')? '...'? Type '?'? ;
TMember = ('readonly' | '-' 'readonly' | '+' 'readonly')? (PropName '?'? (':' Type)? | PropName '?'? TParams? @Params (':' TypePred)? | @IndexSig ('-'? '?')? ':' Type | TParams? @Params (':' TypePred)? | 'new' TParams? @Params (':' Type)? | ('get' | 'set') PropName @Params (':' Type)?) (';' | ',' | $) | ';' ;
TMembers = TMember* ;
EnumItem = (Id | STR) ('=' Assign)? ;
IndexSig = Id ':' Type | Id 'in' Type ('as' Type)? ;
"""


class JavaScript(Language):
    keywords = ("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum "
                "of async get set static from as let type declare namespace abstract readonly is keyof infer satisfies asserts module interface private public protected implements override await yield unique")
    typed = False
    pattern = re.compile(
        r"(//[^\n]*|/\*[\s\S]*?\*/|\A#![^\n]*)|(" + _DQ + "|" + _SQ + r")|(" + _TEMPLATE + r")"
        r"|([=(,:\[!&|?{};+*%~^>\n]|\A|=>|\breturn\b|\btypeof\b)([ \t]*)/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
        r"|([#]?(?:[^\W\d]|\$)[\w$]*)|(" + _NUM + r")")
    ops = [("...", ELL), ("=>", ARR), (">>>=", ASG), (">>=", ASG), ("<<=", ASG), ("**=", ASG), ("&&=", ASG), ("||=", ASG), ("??=", ASG), ("===", CMP), ("!==", CMP), ("==", CMP), ("!=", CMP), ("<=", CMP), (">=", CMP),
           ("+=", ASG), ("-=", ASG), ("*=", ASG), ("/=", ASG), ("%=", ASG), ("&=", ASG), ("|=", ASG), ("^=", ASG), ("++", INC), ("--", INC), ("&&", "&"), ("||", "|"), ("??", "|"), ("?.", "."), ("**", "*")]

    def __init__(self):
        g = JS_GRAMMAR + (_TS_ONLY if self.typed else "")
        for k in sorted(_TS, key=len, reverse=True):
            g = g.replace(k + " ", _TS[k] + " " if self.typed else "").replace(k + ")", _TS[k] + ")" if self.typed else ")")
        self.inside: dict[str, bool] = {}
        self.holes = re.compile(r"\\[\s\S]|\$\{((?:[^`{}'\"/]|" + _DQ + "|" + _SQ + r"|/(?![*/])|/\*[\s\S]*?\*/|\{(?:[^`{}'\"]|" + _DQ + "|" + _SQ + r"|\{[^`{}]*\})*+\}|" + _TEMPLATE + r")*+)\}")
        super().__init__(g)
        kw = self.kw
        endable = "a0" + STR + TPL + INC + "!" * self.typed + GROUP + "".join(kw[w] for w in kw if w not in ("case", "const", "delete", "do", "else", "export", "extends", "for", "function", "if", "import", "in", "instanceof", "new", "switch", "throw", "try", "typeof", "var", "while", "with", "class", "of", "let") and (self.typed or w != "void"))
        follow = re.escape(".,)]}?:+-*/%&|^=<>") + CMP + ASG + ARR + TPL + GROUP + "".join(kw[w] for w in ("catch", "finally", "in", "instanceof", "extends") + (("as", "satisfies", "implements") if self.typed else ()))
        self.newline = re.compile(f"(?<=[{endable}])\n+(?=[^{follow};\n])")
        self.before_else = re.compile(f"([{GROUP}])\x01(?={kw['else']})")

    def token(self, m):
        i = m.lastindex
        if i == 6:
            return self.kw.get(m.group(), "a")
        if i == 7:
            return "0"
        if i == 2:
            return STR
        if i == 3:
            return TPL if "${" not in m.group() or self.template(m.group()) else BROKEN
        if i == 5:
            head = m.group(4)
            return (self.kw.get(head, head)) + STR
        return "\n" if "\n" in m.group() else " "

    def template(self, literal: str) -> bool:
        """Whether the expressions inside a template literal parse."""
        for m in self.holes.finditer(literal[1:-1]):
            if m.group(1) is not None:
                inner = self.inside.get(m.group(1))
                if inner is None:
                    s = self.reduce(self.shape(m.group(1)))
                    inner = s is not None and self.g.derives("Expr", s.replace("\n", ""))
                    if len(self.inside) > 100_000:
                        self.inside.clear()
                    self.inside[m.group(1)] = inner
                if not inner:
                    return False
        return True

    arrows = True

    def narrowed(self, before: str, ch: str) -> str | None:
        """Braces after an arrow are the function's body and nothing else."""
        if before != ARR:
            return ch
        mask = self.g.masks[ch] & (1 << self.g.groups["Block"] | (1 << self.g.groups["TObj"] if self.typed else 0))
        return self.g.group_char(mask) if mask else None

    def semicolons(self, s: str) -> str:
        """Line ends that end a statement as ``;``, the others dropped. A line end before ``else`` does so unless a block went before."""
        s = self.newline.sub("\x01", s.strip("\n")).replace("\n", "")
        s = self.before_else.sub(lambda m: m.group(1) if self.g.masks[m.group(1)] & self.blocky else m.group(), s)
        return s.replace("\x01", ";")

    def split(self, s: str) -> list[str]:
        s = self.semicolons(s)
        # Only brace groups end a statement; which groups are braces shows in their readings.
        out, at = [], 0
        blocky, masks, n = self.blocky, self.g.masks, len(s)
        go_on, hold = self.go_on, self.hold
        for i, c in enumerate(s):
            if c == ";":
                if i + 1 < n and s[i + 1] in hold:
                    continue
            elif not (masks.get(c, 0) & blocky) or i + 1 < n and (s[i + 1] in go_on or s[i + 1] in masks):
                continue
            out.append(s[at : i + 1])
            at = i + 1
        if at < n:
            out.append(s[at:])
        return out

    def brackets(self):
        g, L, W = self.g, self.listing, self.whole
        kw = self.kw
        self.hold = {kw["else"], kw["while"]}
        self.go_on = set(".,)]?:+*/%&|^=<>-") | {CMP, ASG, ARR, TPL} | {kw[w] for w in ("else", "catch", "finally", "in", "instanceof", "while", "from", "as", "satisfies")}
        for name in ("Block", "ClassBody", "SwitchBody", "TObj", "Enum", "Object", "Names", "Ambient", "Space"):
            g.groups.setdefault(name, len(g.groups))
        self.blocky = sum(1 << g.groups[x] for x in ("Block", "ClassBody", "SwitchBody", "TObj", "Enum", "Object", "Names", "Ambient", "Space"))
        comma = L("Assign", empty=False, trailing=False, whole="Expr")
        out = {
            "(": [("Args", L("Arg", whole="ArgList")), ("Paren", comma), ("Params", L("Param", whole="ParamList")), ("ForHead", W("ForHead"))],
            "[": [("Array", L("Elem", holes=True, whole="ArgList")), ("Index", comma)],
            "{": [("Block", self.pieces("Stmt", "Seq")), ("Object", L("Prop", whole="Props")), ("ClassBody", self.pieces("Member", "Members")), ("Names", L("NameItem")), ("SwitchBody", lambda s: g.derives("Switch", self.semicolons(s)))],
        }
        if self.typed:
            out["("].append(("TParen", W("Type")))
            out["["] += [("TIndex", lambda s: s.strip("\n") == "" or W("Type")(s)), ("TTuple", L("TElem")), ("IndexSig", W("IndexSig"))]
            out["{"] += [("TObj", self._members), ("Enum", L("EnumItem")), ("Ambient", self.pieces("Ambient")), ("Space", self.pieces("Item", "Items"))]
        return out

    def _members(self, s: str) -> bool:
        s = self.semicolons(s)
        parts = re.findall(r"[^;,]*[;,]|[^;,]+$", s)
        return all(self.g.derives("TMember", p) for p in set(parts)) or self.g.derives("TMembers", s)

    def accepts(self, s):
        return all(self.g.derives("Item", p) or self.g.derives("Items", p) for p in set(self.split(s)))


class TypeScript(JavaScript):
    typed = True


JAVA_GRAMMAR = r"""
Q = NAME ('.' NAME)* ;
Ann = '@' Q @Args? ;
Mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | Ann ;
TArg = Ann* ('?' (('extends' | 'super') Type)? | Type) ;
TArgs = '<' '>' | '<' TArg (',' TArg)* '>' ;
TPar = NAME ('extends' Type ('&' Type)*)? ;
TPars = '<' TPar (',' TPar)* '>' ;
Type = Ann* NAME TArgs? ('.' NAME TArgs?)* (@Empty)* ;
Item = 'package' Q ';' | Ann 'package' Q ';' | 'import' 'static'? Q ('.' '*')? ';' | TypeDecl | ';' ;
Items = Item+ ;
TypeList = Type (',' Type)* ;
TypeDecl = Mod* ('class' NAME TPars? ('extends' Type)? ('implements' TypeList)? ('permits' TypeList)? @ClassBody | 'interface' NAME TPars? ('extends' TypeList)? ('permits' TypeList)? @ClassBody | 'record' NAME TPars? @Params ('implements' TypeList)? @ClassBody | 'enum' NAME ('implements' TypeList)? @EnumBody | '@' 'interface' NAME @ClassBody) ;
Init = Expr | @ArrayInit ;
Declr = NAME (@Empty)* ('=' Init)? ;
Member = Mod* (TPars? (Type | 'void')? NAME @Params (@Empty)* ('throws' TypeList)? (@Block | ('default' Init)? ';') | Type Declr (',' Declr)* ';' | NAME @Block | @Block) | TypeDecl | ';' ;
Members = Member+ ;
EnumConst = Ann* NAME @Args? @ClassBody? ;
EnumBody = (EnumConst (',' EnumConst)*)? ','? (';' Members?)? ;
Param = Mod* Type '...'? (NAME | 'this') (@Empty)* ;
LParam = Param | NAME ;
ParamList = Param (',' Param)* ;
Stmt = @Block | Mod* Type Declr (',' Declr)* ';' | Effect ';' | 'if' @Paren Stmt ('else' Stmt)? | 'for' @ForHead Stmt | 'while' @Paren Stmt | 'do' Stmt 'while' @Paren ';' | 'try' @Resources? @Block ('catch' @Catch @Block)* ('finally' @Block)? | 'switch' @Paren @SwitchBody
  | 'return' Expr? ';' | 'throw' Expr ';' | ('break' | 'continue') NAME? ';' | 'yield' Expr ';' | 'synchronized' @Paren @Block | 'assert' Expr (':' Expr)? ';' | NAME ':' Stmt | TypeDecl | ';' ;
Seq = Stmt+ ;
Effect = Mem ('=' | ASG) Expr | INC Mem | Mem INC | Prim Suf* @Args | 'new' Creator ;
Expr = Cond (('=' | ASG) Expr)? | (NAME | @LParams) '->' (Expr | @Block) ;
Cond = Bin ('?' Expr ':' (Cond | (NAME | @LParams) '->' (Expr | @Block)))? ;
Bin = Un (BinOp Un | 'instanceof' 'final'? (Type NAME? | NAME @RecPat))* ;
BinOp = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | CMP | '<' | '>' | '<' '<' | '>' '>' | '>' '>' '>' ;
Un = ('!' | '~' | '+' | '-' | INC) Un | @Cast Un | @Cast (NAME | @LParams) '->' (Expr | @Block) | Mem INC? ;
Mem = Prim Suf* ;
Suf = '.' TArgs? NAME | '.' ('this' | 'super' | 'class' | 'new' Creator) | @Index | @Args | '::' TArgs? (NAME | 'new') ;
Prim = NAME | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | @Paren | 'new' Creator | Type '::' (NAME | 'new') | Type '.' 'class' | 'void' '.' 'class' | 'switch' @Paren @SwitchBody ;
Creator = NAME TArgs? ('.' NAME TArgs?)* (@Args @ClassBody? | (@Index | @Empty)+ @ArrayInit?) ;
ForHead = (Mod* Type Declr (',' Declr)* | Expr (',' Expr)*)? ';' Expr? ';' (Effect (',' Effect)*)? | Mod* Type NAME ':' Expr ;
Resource = Mod* Type NAME '=' Expr ';'? | Expr ';'? ;
Resources = Resource+ ;
Catch = Mod* Type ('|' Type)* NAME ;
Switch = (SwLabel (':' Seq? | '->' (Expr ';' | @Block | 'throw' Expr ';')))* ;
SwLabel = 'case' CaseItem (',' CaseItem)* ('when' Expr)? | 'default' ;
CaseItem = Cond | Type NAME | 'default' | NAME @RecPat ;
RecItem = Type NAME | NAME @RecPat ;
Cast = Type ('&' Type)* ;
Arg = Expr | NAME '=' Init | Init ;
ArgList = Arg (',' Arg)* ;
"""


class Java(Language):
    keywords = "public private protected static final abstract native synchronized transient volatile strictfp default sealed package import class interface record enum extends implements permits throws if else for while do try catch finally switch case return throw break continue yield assert instanceof new this super null true false void when"
    pattern = re.compile(r"(//[^\n]*|/\*[\s\S]*?\*/)|(\"\"\"[\s\S]*?\"\"\"|" + _DQ + r"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\.)(?:[0-7]{0,2})')|((?:[^\W\d]|\$)[\w$]*)|(" + _NUM + ")")
    ops = [("...", ELL), ("->", RET), ("::", COL2), (">>>=", ASG), (">>=", ASG), ("<<=", ASG), ("==", CMP), ("!=", CMP), ("<=", CMP), (">=", CMP), ("+=", ASG), ("-=", ASG), ("*=", ASG), ("/=", ASG), ("%=", ASG), ("&=", ASG), ("|=", ASG), ("^=", ASG), ("++", INC), ("--", INC), ("&&", AND2), ("||", OR2)]
    drop = Language.drop + "\n"

    def __init__(self):
        super().__init__(JAVA_GRAMMAR)

    def token(self, m):
        i = m.lastindex
        if i == 3:
            w = self.kw.get(m.group(), "a")
            return w
        return "0" if i == 4 else STR if i == 2 else " "

    def split(self, s):
        out, at, n = [], 0, len(s)
        masks, blocky = self.g.masks, self.blocky
        for i, c in enumerate(s):
            if c == ";":
                if i + 1 < n and s[i + 1] in self.hold:
                    continue
            elif not (masks.get(c, 0) & blocky) or i + 1 < n and (s[i + 1] in self.go_on or s[i + 1] in masks):
                continue
            out.append(s[at : i + 1])
            at = i + 1
        if at < n:
            out.append(s[at:])
        return out

    def brackets(self):
        L, W, g, kw = self.listing, self.whole, self.g, self.kw
        self.hold = {kw["else"], kw["while"]}
        self.go_on = set(".,?:+*/%&|^=<>-;") | {CMP, ASG, COL2, AND2, OR2} | {kw[w] for w in ("else", "catch", "finally", "instanceof", "while")}
        for name in ("Block", "ClassBody", "SwitchBody", "EnumBody", "ArrayInit"):
            g.groups.setdefault(name, len(g.groups))
        self.blocky = sum(1 << g.groups[x] for x in ("Block", "ClassBody", "SwitchBody", "EnumBody", "ArrayInit"))
        return {
            "(": [("Args", L("Arg", trailing=False, whole="ArgList")), ("Paren", W("Expr")), ("Params", L("Param", trailing=False, whole="ParamList")), ("LParams", L("LParam", trailing=False)), ("ForHead", W("ForHead")), ("Resources", W("Resources")), ("Catch", W("Catch")), ("Cast", W("Cast")), ("RecPat", L("RecItem"))],
            "[": [("Empty", lambda s: not s), ("Index", W("Expr"))],
            "{": [("Block", self.pieces("Stmt", "Seq")), ("ClassBody", self.pieces("Member", "Members")), ("ArrayInit", L("Init", whole="ArgList")), ("EnumBody", W("EnumBody")), ("SwitchBody", W("Switch"))],
        }

    def accepts(self, s):
        return all(self.g.derives("Item", p) or self.g.derives("Items", p) for p in set(self.split(s)))


GO_GRAMMAR = r"""
Q = NAME ('.' NAME)? ;
Type = Q (@Index)? | '*' Type | @ArrLen Type | 'map' @Index Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Sig | 'struct' @StructBody | 'interface' @IfaceBody | @ParenType ;
Sig = @Params (@Params | Type)? ;
File = ';'* Line (';' Line)* ';'? ;
Line = 'package' NAME | 'import' (ImpSpec | @ImpGroup) | Decl | 'func' @Params? NAME @Index? Sig @Block? ;
ImpSpec = (NAME | '.')? STR ;
Names = NAME (',' NAME)* ;
Decl = ('var' | 'const') (ValSpec | @ValGroup) | 'type' (TypeSpec | @TypeGroup) ;
ValSpec = Names (Type ('=' ExprList)? | ('=' ExprList)?) ;
TypeSpec = NAME @Index? '='? Type ;
ExprList = Expr (',' Expr)* ;
Simple = ExprList ((('=' | ASG | ':=') ExprList) | INC | '<-' Expr)? ;
Stmts = Stmt (';' Stmt)* ';'? | ';' ;
Stmt = Simple | Decl | 'if' (Simple? ';')? Expr @Block ('else' (IfOnly | @Block))? | 'for' ForHead? @Block | 'switch' (Simple? ';')? SwHead? @SwitchBody | 'select' @SwitchBody | ('go' | 'defer') Expr | 'return' ExprList? | ('break' | 'continue' | 'goto') NAME? | 'fallthrough' | @Block | NAME ':' Stmt? ;
IfOnly = 'if' (Simple? ';')? Expr @Block ('else' (IfOnly | @Block))? ;
SwHead = Simple ;
ForHead = Simple | (ExprList ('=' | ':='))? 'range' Expr | Simple? ';' Expr? ';' Simple? ;
Switch = ';'* (SwLabel ':' ';'* Stmts? ';'*)* ;
SwLabel = 'case' (Simple | Type (',' Type)*) | 'default' ;
Expr = Un (BinOp Un)* ;
BinOp = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | CMP | '<' | '>' | '<' '<' | '>' '>' | '&' '^' ;
Un = ('!' | '+' | '-' | '^' | '*' | '&' | '<-') Un | Mem ;
Mem = Prim Suf* ;
Suf = '.' NAME | '.' @TypeAssert | @Index | @Args | @Lit ;
Prim = NAME | NUM | STR | @Paren | 'func' Sig @Block | LitType @Lit | LitType @Args ;
LitType = @ArrLen Type | 'map' @Index Type | 'chan' '<-'? Type | 'struct' @StructBody | 'interface' @IfaceBody | @ParenType ;
Param = Names? '...'? Type | NAME '...' Type ;
TParamItem = NAME (TUnion)? | TUnion ;
TUnion = '~'? Type ('|' '~'? Type)* ;
Field = Names Type STR? | '*'? Q @Index? STR? ;
Method = NAME Sig | TUnion ;
Arg = Expr '...'? | Type ;
Idx = Expr | Expr? ':' Expr? (':' Expr)? | Type (',' Type)* | TParamItem (',' TParamItem)* ;
LitItem = (LitVal ':')? LitVal ;
LitVal = Expr | @Lit ;
ArrLen = Expr | '...' ;
TypeAssert = Type | 'type' ;
"""


class Go(Language):
    keywords = "package import func var const type struct interface map chan if else for switch select case default go defer return break continue goto fallthrough range"
    pattern = re.compile(r"(//[^\n]*|/\*[\s\S]*?\*/)|(" + _DQ + r"|`[^`]*`|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))')|(" + _ID + ")|(" + _NUM + ")")
    ops = [("...", ELL), (":=", DEF), ("<-", CHN), ("<<=", ASG), (">>=", ASG), ("&^=", ASG), ("==", CMP), ("!=", CMP), ("<=", CMP), (">=", CMP), ("+=", ASG), ("-=", ASG), ("*=", ASG), ("/=", ASG), ("%=", ASG), ("&=", ASG), ("|=", ASG), ("^=", ASG), ("++", INC), ("--", INC), ("&&", AND2), ("||", OR2)]

    def __init__(self):
        super().__init__(GO_GRAMMAR)

    def token(self, m):
        i = m.lastindex
        if i == 3:
            return self.kw.get(m.group(), "a")
        if i == 1:
            return "\n" if "\n" in m.group() or m.group().startswith("//") and False else " "
        return "0" if i == 4 else STR

    def lines(self, s: str) -> list[str]:
        """Statements: line ends after a name, literal, group or the like end one; others are dropped."""
        return [x for x in self.ender.sub("", s).split("\n") if x]

    def each(self, nt: str):
        return lambda s: all(self.g.derives(nt, p) for x in set(self.lines(s)) for p in x.split(";") if p)

    def block(self, s: str) -> bool:
        return all(self.g.derives("Stmts", p) for p in set(self.lines(s)))

    def brackets(self):
        L, W, g = self.listing, self.whole, self.g
        kw = self.kw
        ends = "a0" + STR + INC + GROUP + "".join(kw[w] for w in ("return", "break", "continue", "fallthrough"))
        self.ender = re.compile(f"(?<![{ends}])\n+|\\A\n+")
        strict = lambda chk: lambda s: "\n" not in self.ender.sub("", s) and chk(s)  # noqa: E731  a line may not end before the bracket closes
        lines = self.lines
        return {
            "(": [("Args", strict(L("Arg"))), ("Paren", strict(W("Expr"))), ("Params", strict(L("Param"))), ("ParenType", strict(W("Type"))), ("TypeAssert", W("TypeAssert")), ("ImpGroup", self.each("ImpSpec")), ("ValGroup", self.each("ValSpec")), ("TypeGroup", self.each("TypeSpec"))],
            "[": [("Index", strict(W("Idx"))), ("ArrLen", lambda s: not s or W("ArrLen")(s))],
            "{": [("Block", self.block), ("Lit", strict(L("LitItem"))), ("StructBody", self.each("Field")), ("IfaceBody", self.each("Method")), ("SwitchBody", lambda s: g.derives("Switch", ";".join(lines(s))))],
        }

    def accepts(self, s):
        ls = self.lines(s)
        if not ls or not ls[0].startswith(self.kw["package"]):
            return False
        return all(self.g.derives("File", p) for p in set(ls))


RUST_GRAMMAR = r"""
Seg = (NAME | 'self' | 'super' | 'crate' | 'Self' | 'union' | 'auto' | 'default' | 'macro_rules') (Gen | '::' Gen | @TTuple RetT?)? ;
Path = '::'? Seg ('::' Seg)* | QSelf ('::' Seg)+ ;
QSelf = '<' Type ('as' Path)? '>' ;
Gen = '<' (GArg (',' GArg)* ','?)? '>' ;
GArg = LIFE | Type | '-'? NUM | STR | 'true' | 'false' | @Block | NAME Gen? '=' Type | NAME ':' Bounds ;
RetT = '->' Type ;
Type = '&' LIFE? 'mut'? Type | '&&' LIFE? 'mut'? Type | '*' ('const' | 'mut') Type | Path | @TTuple | @TArray | ForL? 'unsafe'? ('extern' STR?)? 'fn' @FnTParams RetT? | 'impl' Bounds | 'dyn' Bounds | '!' | Path '!' @Any ;
ForL = 'for' Gen ;
Bounds = Bound ('+' Bound)* ;
Bound = LIFE | '?'? ForL? Path | @TTuple ;
GPar = Attr* (LIFE (':' Bounds?)? | 'const' NAME ':' Type ('=' Expr)? | NAME (':' Bounds?)? ('=' Type)?) ;
GPars = '<' (GPar (',' GPar)* ','?)? '>' ;
Where = 'where' (WItem (',' WItem)* ','?)? ;
WItem = ForL? (Type | LIFE) ':' Bounds? ;
Attr = '#' '!'? @Attr ;
Vis = 'pub' @Any? ;
Item = Attr* Vis? ItemKind | Attr ;
ItemKind = FnHead @Block | FnHead ';' | 'struct' NAME GPars? (Where? @Fields | @TFields Where? ';' | ';') | ('enum') NAME GPars? Where? @Enum | 'union' NAME GPars? Where? @Fields | 'unsafe'? 'impl' GPars? '!'? Type ('for' Type)? Where? @Items | 'unsafe'? 'auto'? 'trait' NAME GPars? (':' Bounds?)? Where? @Items
  | 'use' UseTree ';' | 'unsafe'? 'mod' NAME (';' | @Items) | 'const' NAME ':' Type ('=' Expr)? ';' | 'static' 'mut'? NAME ':' Type ('=' Expr)? ';' | 'type' NAME GPars? (':' Bounds)? Where? ('=' Type)? Where? ';' | 'unsafe'? 'extern' STR? @Items | 'extern' 'crate' (NAME | 'self') ('as' NAME)? ';' | Path '!' NAME? @Any ';'? ;
FnHead = ('default' | 'const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' NAME GPars? @Params RetT? Where? ;
UseTree = '::'? (NAME | 'self' | 'super' | 'crate' | 'Self') ('::' (NAME | 'self' | 'super'))* ('as' NAME | '::' (@UseList | '*'))? | '::'? (@UseList | '*') ;
ItemSeq = Item+ ;
Field = Attr* Vis? NAME ':' Type ;
TField = Attr* Vis? Type ;
Variant = Attr* Vis? NAME (@Fields | @TFields)? ('=' Expr)? ;
Param = Attr* (Pat ':' Type | ('&' LIFE?)? 'mut'? 'self' (':' Type)? | '...') ;
ParamList = Param (',' Param)* ','? ;
FnTP = (NAME ':')? Type | '...' ;
Stmt = Attr* ('let' Pat (':' Type)? ('=' Expr ('else' @Block)?)? ';' | Item | Expr ';' | BlockLike | ';') | Expr $ ;
Seq = Stmt+ ;
Pat = '|'? Pat1 ('|' Pat1)* ;
Pat1 = 'ref'? 'mut'? NAME ('@' Pat1)? | '-'? NUM | STR | 'true' | 'false' | Path | Path @PTuple | Path @PFields | @PTuple | @PArray | '&' 'mut'? Pat1 | '&&' 'mut'? Pat1 | Lit? ('..' '='?) Lit? | Path '!' @Any | 'box' Pat1 ;
Lit = '-'? NUM | STR | Path ;
BlockLike = 'unsafe' @Block | 'async' 'move'? @Block | (LIFE ':')? @Block | If | 'match' Expr @Match | (LIFE ':')? ('loop' @Block | 'while' Cond @Block | 'for' Pat 'in' Expr @Block) | 'const' @Block ;
If = 'if' Cond @Block ('else' (If | @Block))? ;
Cond = Expr | 'let' Pat '=' Expr | Cond '&&' Cond ;
Expr = Assign ;
Assign = Range (('=' | ASG) Assign)? | 'return' Expr? | 'break' LIFE? Expr? | 'continue' LIFE? | Closure | 'yield' Expr? ;
Closure = 'static'? 'async'? 'move'? ('||' | '|' (CParam (',' CParam)* ','?)? '|') (RetT @Block | Expr) ;
CParam = Pat1 (':' Type)? ;
Range = Bin? '..' '='? Bin? | Bin ;
Bin = Un (BinOp Un | 'as' Type)* ;
BinOp = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | CMP | '<' | '>' | '<' '<' | '>' '>' ;
Un = ('!' | '-' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ('const' | 'mut')) Un | Mem | Closure ;
Mem = Prim Suf* ;
Suf = '.' (NAME ('::' Gen)? | NUM | 'await') | @Index | @Args | '?' ;
Prim = Path | Path @StructLit | NUM | STR | 'true' | 'false' | @Tuple | @Array | BlockLike | Path '!' @Any ;
SField = Attr* (NAME | NUM) (':' Expr)? | '..' Expr? ;
PField = Attr* ('ref'? 'mut'? NAME | (NAME | NUM) ':' Pat | '..') ;
Arm = Attr* Pat ('if' Cond)? '=>' (Expr ',' | BlockLike | Expr $) ;
Arms = Arm* ;
ArrayE = Expr ';' Expr ;
ArrayT = Type (';' Expr)? ;
"""


class Rust(Language):
    keywords = "self super crate Self union auto default macro_rules as mut const fn unsafe extern impl dyn for where pub struct enum trait use mod static type let else if match loop while in return break continue async move yield ref box true false await raw"
    pattern = re.compile(
        r"(//[^\n]*|/\*[\s\S]*?\*/)|(b?r(#*)\"[\s\S]*?\"\3|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')|('[^\W\d]\w*(?!'))|((?:r#)?" + _ID + r")|(0[xXbBoO][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?(?:_?[iuf]\d+|_?[iu]size)?)")
    ops = [("...", ELL), ("..=", RNG + "="), ("..", RNG), ("->", RET), ("=>", ARR), ("::", COL2), ("<<=", ASG), (">>=", ASG), ("==", CMP), ("!=", CMP), ("<=", CMP), (">=", CMP), ("+=", ASG), ("-=", ASG), ("*=", ASG), ("/=", ASG), ("%=", ASG), ("&=", ASG), ("|=", ASG), ("^=", ASG), ("&&", AND2), ("||", OR2)]
    drop = Language.drop + "\n"

    def __init__(self):
        super().__init__(RUST_GRAMMAR)

    def token(self, m):
        i = m.lastindex
        if i == 5:
            return self.kw.get(m.group(), "a")
        return "0" if i == 6 else LIFE if i == 4 else " " if i == 1 else STR

    def split(self, s):
        out, at, n = [], 0, len(s)
        masks, blocky = self.g.masks, self.blocky
        for i, c in enumerate(s):
            if c == ";":
                pass
            elif not (masks.get(c, 0) & blocky) or i + 1 < n and (s[i + 1] in self.go_on or s[i + 1] in masks):
                continue
            out.append(s[at : i + 1])
            at = i + 1
        if at < n:
            out.append(s[at:])
        return out

    def brackets(self):
        L, W, g = self.listing, self.whole, self.g
        self.go_on = set(".,?:+*/%&|^=<>-;") | {CMP, ASG, COL2, AND2, OR2, RNG, ARR} | {self.kw[w] for w in ("else", "as")}
        for name in ("Block", "Items", "Fields", "Enum", "Match", "StructLit"):
            g.groups.setdefault(name, len(g.groups))
        self.blocky = sum(1 << g.groups[x] for x in ("Block", "Items", "Fields", "Enum", "Match", "StructLit"))
        any_ = ("Any", lambda s: True)
        return {
            "(": [("Args", L("Expr")), ("Tuple", L("Expr")), ("Params", L("Param", whole="ParamList")), ("TTuple", L("Type")), ("TFields", L("TField")), ("PTuple", L("Pat")), ("FnTParams", L("FnTP")), any_],
            "[": [("Index", W("Expr")), ("Array", lambda s: L("Expr")(s) or W("ArrayE")(s)), ("TArray", W("ArrayT")), ("PArray", L("Pat")), ("Attr", lambda s: True), any_],
            "{": [("Block", self.pieces("Stmt", "Seq")), ("Items", self.pieces("Item", "ItemSeq")), ("Fields", L("Field")), ("Enum", L("Variant")), ("Match", W("Arms")), ("StructLit", L("SField")), ("PFields", L("PField")), ("UseList", L("UseTree")), any_],
        }

    def accepts(self, s):
        return all(self.g.derives("Item", p) or self.g.derives("ItemSeq", p) for p in set(self.split(s)))


PY_GRAMMAR = r"""
Id = NAME | 'match' | 'case' | 'type' ;
Line = Simple (';' Simple)* ';'? ;
Simple = ExprStmt | 'return' Exprs? | 'pass' | 'break' | 'continue' | 'raise' (Expr ('from' Expr)?)? | ('global' | 'nonlocal') Id (',' Id)* | 'del' Targets | 'assert' Expr (',' Expr)? | 'import' Dotted ('as' Id)? (',' Dotted ('as' Id)?)* | 'from' ('.' | '...')* Dotted 'import' ImpTargets | 'from' ('.' | '...')+ 'import' ImpTargets | 'type' Id @Index? '=' Expr ;
Dotted = Id ('.' Id)* ;
ImpTargets = '*' | @Imports | Imp (',' Imp)* ;
Imp = Id ('as' Id)? ;
ExprStmt = Exprs | (Targets '=')+ (Exprs | Yield) | Single ASG (Exprs | Yield) | Single ':' Expr ('=' (Exprs | Yield))? | Yield ;
Single = Id | Mem ('.' Id | @Index) | @One ;
Yield = 'yield' ('from' Expr | Exprs)? ;
Exprs = Star (',' Star)* ','? ;
Star = '*' Or | Expr ;
Expr = Lambda | Or ('if' Or 'else' Expr)? ;
Named = Id ':=' Expr | Expr ;
Lambda = 'lambda' LParams? ':' Expr ;
LParams = LParam (',' LParam)* ','? ;
LParam = Id ('=' Expr)? | '*' Id? | '**' Id | '/' ;
Or = Not (('and' | 'or') Not)* ;
Not = 'not' Not | Cmp ;
Cmp = Arith ((CMP | '<' | '>' | 'in' | 'not' 'in' | 'is' 'not'? ) Arith)* ;
Arith = Un (BinOp Un)* ;
BinOp = '+' | '-' | '*' | '**' | '/' | '%' | '@' | '&' | '|' | '^' | '<' '<' | '>' '>' ;
Un = ('+' | '-' | '~' | 'await') Un | Mem ;
Mem = Prim ('.' Id | @Index | @Args)* ;
Prim = Id | NUM | STR+ | 'None' | 'True' | 'False' | '...' | @Paren | @List | @Dict ;
Comp = ('async'? 'for' Targets 'in' Or CompIf*)+ ;
CompIf = 'if' (Or | Lambda | Id ':=' Expr) ;
Targets = Target (',' Target)* ','? ;
Target = '*'? (Id | Mem ('.' Id | @Index) | @Aims) ;
ParenAll = (StarN (',' StarN)* ','?)? | StarN Comp | Yield ;
StarN = '*' Or | Named ;
ListAll = (StarN (',' StarN)* ','?)? | StarN Comp ;
Arg = StarN | '**' Expr | Id '=' Expr | Named Comp ;
Slice = Expr? ':' Expr? (':' Expr?)? | StarN ;
DItem = Expr ':' Expr | '**' Or ;
SItem = StarN ;
ArgsAll = Arg (',' Arg)* ','? ;
ParamsAll = Param (',' Param)* ','? ;
DictAll = DItem (',' DItem)* ','? ;
DictComp = Expr ':' Expr Comp | StarN Comp ;
Param = Id (':' Star)? ('=' Expr)? | '*' (Id (':' Star)?)? | '**' Id (':' Expr)? | '/' ;
Head = Cond ':' ;
Cond = 'if' Named | 'while' Named | 'for' Targets 'in' Exprs | 'async' 'for' Targets 'in' Exprs | 'with' Withs | 'async' 'with' Withs | 'def' Id @Index? @Params ('->' Expr)? | 'async' 'def' Id @Index? @Params ('->' Expr)? | 'class' Id @Index? @Args? ;
Withs = With (',' With)* | @WithList ;
With = Expr ('as' Target)? ;
Try = 'try' ':' ;
Elif = 'elif' Named ':' ;
Else = 'else' ':' ;
Except = 'except' '*'? (Expr ('as' Id)?)? ':' ;
Finally = 'finally' ':' ;
Match = 'match' StarN (',' StarN)* ','? ':' ;
Case = 'case' Pats ('if' Named)? ':' ;
Pats = PatAs (',' PatAs)* ','? ;
PatAs = '*' Id | PatOr ('as' Id)? ;
PatOr = Pat ('|' Pat)* ;
Pat = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Id ('.' Id)* @PArgs? | @PSeq | @PMap ;
PArg = (Id '=')? PatAs ;
PMapItem = Pat ':' PatAs | '**' Id ;
Deco = '@' Named ;
Suite = Unit* ;
Unit = 's' | ('i' B Elifs? | 'l' B ('e' B)?) | 't' B ((('x' B)+ ('e' B)? ('f' B)?) | 'f' B) | 'd'* 'h' B | 'm' M ;
Elifs = ('n' B Elifs? | 'e' B) ;
B = 'B' ;
M = 'M' ;
CaseSuite = ('c' B)+ ;
"""


class Python(Language):
    keywords = "match case type return pass break continue raise from global nonlocal del assert import as yield if else lambda and or not in is await None True False async for while with def class try elif except finally"
    pattern = re.compile(
        r"(#[^\n]*|\\\r?\n)|(?:[rRbBuUfFtT]{1,2})?(\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|" + _DQ + "|" + _SQ + r")|([^\W\d][\w]*)|((?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d+)?[jJ]?))")
    ops = [("...", ELL), ("->", RET), ("**=", ASG), ("//=", ASG), ("<<=", ASG), (">>=", ASG), ("==", CMP), ("!=", CMP), ("<=", CMP), (">=", CMP), ("+=", ASG), ("-=", ASG), ("*=", ASG), ("/=", ASG), ("%=", ASG), ("&=", ASG), ("|=", ASG), ("^=", ASG), ("@=", ASG), (":=", DEF), ("**", "\ue0f0"), ("//", "/")]
    drop = "\r\f\v\ufeff"

    def __init__(self):
        self.kinds: dict[str, str | None] = {}
        super().__init__(PY_GRAMMAR.replace("'**'", "POW"))

    def token(self, m):
        i = m.lastindex
        if i == 3:
            return self.kw.get(m.group(), "a")
        if i == 4:
            v = m.group()
            return "0" if not re.fullmatch(r"0\d*[1-9]\d*", v) else "00"
        return STR if i == 2 else "" if m.group()[0] == "#" else " "

    def brackets(self):
        L, g = self.listing, self.g
        strip = lambda f: lambda s: f(s.replace(" ", "").replace("\n", "").replace("\t", ""))
        W = lambda nt: strip(lambda s: g.derives(nt, s))
        P = lambda *a, **k: strip(L(*a, **k))
        any_list = strip(lambda s: L("StarN")(s) or g.derives("ListAll", s))
        return {
            "(": [("Paren", strip(lambda s: L("StarN")(s) or g.derives("ParenAll", s))), ("Args", P("Arg", whole="ArgsAll")), ("Params", P("Param", whole="ParamsAll")), ("Imports", P("Imp", empty=False)), ("WithList", P("With", empty=False)), ("PArgs", P("PArg")), ("PSeq", P("PatAs", whole="Pats")), ("Aims", P("Target")), ("One", W("Single"))],
            "[": [("List", any_list), ("Aims", P("Target")), ("Index", P("Slice", empty=False, whole="Exprs")), ("PSeq", P("PatAs"))],
            "{": [("Dict", strip(lambda s: L("DItem", whole="DictAll")(s) or L("SItem")(s) or g.derives("DictComp", s))), ("PMap", P("PMapItem"))],
        }

    def line(self, s: str) -> str | None:
        """Class of a logical line: a letter of the suite grammar, doubled if its suite follows on the line."""
        if s in self.kinds:
            return self.kinds[s]
        d = self.g.derives
        got = None
        if d("Line", s):
            got = "s"
        else:
            for k, nt in (("h", "Head"), ("t", "Try"), ("n", "Elif"), ("e", "Else"), ("x", "Except"), ("f", "Finally"), ("m", "Match"), ("c", "Case")):
                if d(nt, s):
                    got = k
                    break
            if got == "h":
                got = "i" if s[0] == self.kw["if"] else "l" if s[0] in (self.kw["while"], self.kw["for"]) or s[0] == self.kw["async"] and s[1] == self.kw["for"] else "h"
            if got is None and s.startswith("@") and d("Deco", s):
                got = "d"
            if got is None:
                for i, c in enumerate(s):
                    if c == ":" and i + 1 < len(s) and d("Line", s[i + 1 :]):
                        k = self.line(s[: i + 1])
                        if k in ("i", "h", "l", "t", "n", "e", "x", "f", "c"):
                            got = k + "B"
                            break
        if len(self.kinds) > 400_000:
            self.kinds.clear()
        self.kinds[s] = got
        return got

    def accepts(self, s):
        stack = [(0, [])]
        opened = False  # the last line needs an indented suite
        for raw in s.split("\n"):
            body = raw.lstrip(" \t")
            if not body.strip():
                continue
            lead = raw[: len(raw) - len(body)]
            width = len(lead.expandtabs(8)) if "\t" in lead else len(lead)
            kind = self.line(body.replace(" ", "").replace("\t", ""))
            if kind is None:
                return False
            if opened:
                if width <= stack[-1][0]:
                    return False
                stack.append((width, []))
            else:
                while width < stack[-1][0]:
                    if not self.close(stack):
                        return False
                if width != stack[-1][0]:
                    return False
            stack[-1][1].append(kind)
            opened = kind in ("i", "h", "l", "t", "n", "e", "x", "f", "m", "c")
        if opened:
            return False
        while len(stack) > 1:
            if not self.close(stack):
                return False
        return self.suite("".join(stack[0][1]))

    def close(self, stack) -> bool:
        inner = "".join(stack.pop()[1])
        if stack[-1][1][-1] == "m":
            ok = self.g.derives("CaseSuite", inner)
            stack[-1][1].append("M")
        else:
            ok = self.suite(inner)
            stack[-1][1].append("B")
        return ok

    _UNITS = re.compile(r"s|m.?|[ilt][^silthdm]*|d*h.?|d+")

    def suite(self, s: str) -> bool:
        units = self._UNITS.findall(s)
        return sum(map(len, units)) == len(s) and all(self.g.derives("Unit", u) for u in set(units))


RUBY_GRAMMAR = r"""
Id = NAME | 'attr' ;
Simple = Stmt (';' Stmt)* ';'? ;
Stmt = Expr Mods | ('return' | 'break' | 'next') Args? Mods | 'yield' Args? Mods | 'alias' Sym Sym | 'undef' Sym | 'redo' | 'retry' | Expr 'rescue' Expr ;
Sym = NAME | ':' NAME | STR ;
Mods = (('if' | 'unless' | 'while' | 'until' | 'rescue') Expr)* ;
Expr = 'not' Expr | Expr1 (('and' | 'or') ('not')? Expr1)* ;
Expr1 = Targets '=' Args | Ternary ((ASG | '=') Rhs)? | Command ;
Rhs = Expr1 | Ternary (',' Ternary)+ | '*' Ternary ;
Targets = Target (',' Target)+ ','? ;
Target = '*'? Mem | @Paren ;
Ternary = Range ('?' Ternary ':' Ternary)? | 'defined' Range ;
Range = Bin ('..' Bin?)? | '..' Bin | '...' Bin | Bin '...' Bin? ;
Bin = Un (BinOp Un)* ;
BinOp = '+' | '-' | '*' | POW | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | CMP | '<' | '>' | '<' '<' | '>' '>' ;
Un = ('!' | '-' | '+' | '~' | '&' | '*' | POW) Un | Mem ;
Mem = Prim Suf* ;
Suf = ('.' | '&' '.') Meth | '::' Meth | @Index | @Args | @BBlock ;
Meth = NAME | AnyKw | @Args | '`' ;
AnyKw = 'class' | 'then' | 'end' | 'begin' | 'in' | 'do' | 'if' | 'next' | 'not' | 'and' | 'or' | 'self' | 'nil' | 'true' | 'false' | 'yield' | 'when' | 'case' | 'for' | 'else' | 'ensure' | 'rescue' | 'return' | 'def' | 'module' | 'alias' | 'until' | 'while' | 'unless' | 'super' | 'break' | 'redo' | 'retry' | 'undef' | 'defined' ;
Prim = NAME | NUM | STR+ | 'nil' | 'true' | 'false' | 'self' | 'super' | 'yield' | @Paren | @Array | @Hash | '::' NAME | ':' (NAME | AnyKw | STR) | Inline | '->' (@Params | NAME (',' NAME)*)? @BBlock | 'defined' @Args ;
Inline = ('if' | 'unless') Stmt Then Simple? ('elsif' Stmt Then Simple?)* ('else' ';'? Simple?)? 'end' | 'case' Expr? ';'? ('when' Args Then Simple?)+ ('else' ';'? Simple?)? 'end' | ('while' | 'until') Stmt ('do' | ';') Simple? 'end' | 'begin' ';'? Simple? ('rescue' Args? ('=>' NAME)? Then? Simple?)* ('ensure' ';'? Simple?)? 'end' ;
Then = 'then' | ';' 'then'? ;
Command = Un0 CArgs ;
Un0 = '!'? Prim0 Suf* ;
Prim0 = NAME | 'super' | 'yield' | 'self' | 'nil' | @Paren | @Array | STR+ | '::' NAME | NUM | ':' NAME ;
CArgs = Arg (',' Arg)* ;
Args = Arg (',' Arg)* ;
Arg = ('*' | POW | '&')? ArgE | Pair | '*' | '&' | POW | '...' | '&' ':' NAME ;
ArgE = Expr1 | 'not' Expr1 ;
Pair = (NAME | AnyKw | STR) ':' ArgE? | ArgE '=>' ArgE ;
Elem = Arg ;
HItem = Pair | POW ArgE ;
Param = NAME ('=' Ternary)? | NAME ':' Ternary? | '*' NAME? | POW (NAME | 'nil')? | '&' NAME? | '...' | @PTuple ;
BParams = '|' (BParam (',' BParam)* ','?)? (';' NAME (',' NAME)*)? '|' ;
BParam = NAME ('=' BDef)? | NAME ':' BDef? | '*' NAME? | POW NAME? | '&' NAME | @PTuple ;
BDef = NUM | STR | NAME | 'nil' | 'true' | 'false' | @Array | @Hash ;
BHead = BParams? ;
Do = Expr Mods0 'do' BHead | ('return' | 'break' | 'next') Args 'do' BHead | ('return')? '->' (@Params | NAME)? 'do' ;
Mods0 = ;
Lhs = (Targets | Mem) ('=' | ASG) | Mem '<' '<' | 'return' | Un0 | (Un0 (Arg ',')*) ;
Open = 'def' DefName (@Params | Param (',' Param)*)? | 'class' ('<' '<' Expr | Const ('<' Expr)?) | 'module' Const | ('if' | 'unless' | 'while' | 'until') Stmt ('then' | 'do')? | 'case' Expr? | 'begin' | 'for' NAME (',' NAME)* 'in' Expr 'do'? ;
Const = '::'? NAME ('::' NAME)* ;
DefName = (('self' | NAME) '.')? (NAME | AnyKw) ('=' | '!' | '?')? | (('self' | NAME) '.')? OpName ;
OpName = '+' | '-' | '*' | '/' | '%' | POW | CMP | '<' '<' | '>' '>' | '<' | '>' | @Index | @Index '=' | '!' | '~' | '&' | '|' | '^' | '=' '~' | '+' '@' | '-' '@' ;
Endless = 'def' DefName @Params? '=' Stmt | 'def' DefName @Params? ';' Simple ';'? 'end' | 'class' Const ('<' Expr)? ';' 'end' | 'module' Const ';' 'end' | 'if' Stmt 'then' Simple ('else' Simple)? 'end' | 'begin' ';' 'end' | 'class' Const ('<' Expr)? ';' Simple ';' 'end' ;
Else = 'else' Simple? ;
Elsif = 'elsif' Stmt ('then' Simple?)? ;
When = 'when' Args ('then' Simple?)? ;
In = 'in' Arg (',' Arg)* (('if' | 'unless') Expr)? ('then' Simple?)? ;
Rescue = 'rescue' (Args)? ('=>' NAME)? ('then' Simple?)? ;
Ensure = 'ensure' ;
EndLine = 'end' (Suf* (BinOp Expr)? | Suf* CArgs)? Mods | 'end' Suf* 'do' BHead ;
Body = (Unit)* ;
Unit = 's' | 'o' Body Tail 'E' | 'c' ('w' Body)+ ('e' Body)? 'E' | 'b' Body Tail 'E' | 'i' Body ('l' Body)* ('e' Body)? 'E' ;
Tail = ('r' Body)* ('e' Body)? ('u' Body)? ;
"""


class Ruby(Language):
    keywords = "attr return break next yield alias undef redo retry if unless while until rescue not and or defined class then end begin in do self nil true false when case for else ensure def module super elsif __END__"
    pattern = re.compile(
        r"(#[^\n]*|^=begin\b[\s\S]*?^=end\b[^\n]*|\\\r?\n|^__END__\r?\n[\s\S]*)|(<<[~-]?([\"'`]?)([A-Za-z_]\w*)\3([^\n]*)\n(?:[^\n]*\n)*?[ \t]*\4\b)"
        r"|(\"(?:[^\"\\#]|\\[\s\S]|#(?!\{)|#\{(?:[^{}\"]|\"(?:[^\"\\]|\\.)*\"|\{[^{}]*\})*\})*\"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>)(?<!%\()|(?<=[=(,\[{~!|&\n ])\s*/(?![ =/])(?:[^/\\\n]|\\.)+/[imxounse]*)"
        r"|(:\"(?:[^\"\\]|\\.)*\"|(?<!:):(?:[^\W\d]\w*[?!=]?(?![:\w=>])|[^\W\d]\w*[?!]?(?!:)|\[\]=?|[+\-*/<>=!~%]+))|((?:@@?|\$)?[^\W\d]\w*(?:[?!](?![=~]|:[^:]))?|\$\W)|(\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]*|0[xXbBoO][\da-fA-F_]+)", re.M)
    ops = [("...", ELL), ("..", RNG), ("->", RET), ("=>", ARR), ("::", COL2), ("**=", ASG), ("<<=", ASG), (">>=", ASG), ("&&=", ASG), ("||=", ASG), ("<=>", CMP), ("===", CMP), ("==", CMP), ("!=", CMP), ("=~", CMP), ("!~", CMP), ("<=", CMP), (">=", CMP), ("+=", ASG), ("-=", ASG), ("*=", ASG), ("/=", ASG), ("%=", ASG), ("&=", ASG), ("|=", ASG), ("^=", ASG), ("&&", AND2), ("||", OR2), ("**", "\ue0f0")]

    unnamed = re.compile(r"(?<![.\w:@$])(?:class|module)[ \t]+\Z")

    def __init__(self):
        self.kinds: dict[str, str | None] = {}
        super().__init__(RUBY_GRAMMAR)

    def token(self, m):
        i = m.lastindex
        s = m.group()
        if i == 8:
            before = m.string[m.start() - 1 : m.start()]
            if before == "." and s in self.kw:
                return "a"
            if "a" <= s[0] <= "z" and s not in self.kw and self.unnamed.search(m.string, max(0, m.start() - 12), m.start()) and not m.string.startswith("::", m.end()):
                return BROKEN  # classes and modules have names in capitals
            if s in self.kw and m.string[m.end() : m.end() + 1] == ":" and m.string[m.end() : m.end() + 2] != "::":
                return "a"
            return self.kw.get(s, "a")
        if i == 9:
            return "0"
        if i in (6, 7):
            return STR
        if m.group(2):
            return STR + self.pattern.sub(self.token, m.group(5))
        return "\n" if s.startswith(("=", "__")) else " " if s[0] == "\\" else ""

    def logical(self, s: str) -> list[str]:
        """Lines, joined where an operator or a leading dot continues them."""
        s = self.joiner.sub("", s)
        return [x.strip(";") for x in s.split("\n") if x.strip(";")]

    def block(self, s: str) -> bool:
        s = s.strip("\n")
        m = re.match(r"\|[^|]*\|", s)
        if m:
            if not self.g.derives("BHead", m.group().replace("\n", "")):
                return False
            s = s[m.end() :]
        elif s.startswith(OR2):
            s = s[1:]
        return self.body(self.logical(s))

    def brackets(self):
        L, W, g = self.listing, self.whole, self.g
        self.joiner = re.compile(f"(?<=[,.+\\-*/%&^=<:!{CMP}{ASG}{AND2}{OR2}{ARR}])\n+|\n+(?=&?\\.)")
        join = lambda f: lambda s: f(s.replace("\n", ""))
        paren = lambda s: not s.strip("\n") or W("Simple")(s) or self.body(self.logical(s))
        return {
            "(": [("Args", L("Arg")), ("Paren", paren), ("Params", L("Param", trailing=False)), ("PTuple", L("Param"))],
            "[": [("Array", L("Elem")), ("Index", L("Arg"))],
            "{": [("Hash", L("HItem")), ("BBlock", self.block)],
        }

    def line(self, s: str) -> str | None:
        if s in self.kinds:
            return self.kinds[s]
        d, kw, got = self.g.derives, self.kw, None
        c = s[0]
        if c == kw["end"]:
            if d("EndLine", s):
                got = "Eo" if kw["do"] in s else "E"
        elif c == kw["else"]:
            got = "e" if d("Else", s) else None
        elif c == kw["elsif"]:
            got = "l" if d("Elsif", s) else None
        elif c == kw["when"]:
            got = "w" if d("When", s) else None
        elif c == kw["in"]:
            got = "w" if d("In", s) else None
        elif c == kw["rescue"]:
            got = "r" if d("Rescue", s) else None
        elif c == kw["ensure"]:
            got = "u" if d("Ensure", s) else None
        elif d("Simple", s):
            got = "s"
        elif d("Open", s):
            got = "c" if c == kw["case"] else "i" if c in (kw["if"], kw["unless"]) else "b" if c == kw["begin"] else "o"
        elif d("Endless", s):
            got = "s"
        elif d("Do", s):
            got = "o"
        else:
            m = re.search(f"[{kw['if']}{kw['unless']}{kw['case']}{kw['begin']}{kw['while']}{kw['def']}]", s)
            if m and m.start() and d("Lhs", s[: m.start()]) and d("Open", s[m.start() :]):
                k = s[m.start()]
                got = "c" if k == kw["case"] else "i" if k in (kw["if"], kw["unless"]) else "b" if k == kw["begin"] else "o"
        if len(self.kinds) > 400_000:
            self.kinds.clear()
        self.kinds[s] = got
        return got

    def body(self, lines: list[str]) -> bool:
        """Reduce from the inside: every ``end`` closes the last opener; its unit is checked on its own."""
        stack: list[list[str]] = [[]]
        for ln in lines:
            k = self.line(ln)
            if k is None:
                return False
            if k[0] == "E":
                if len(stack) < 2:
                    return False
                unit = "".join(stack.pop()) + "E"
                if not self.g.derives("Unit", unit):
                    return False
                if k == "Eo":
                    stack.append(["o"])
                else:
                    stack[-1].append("s")
            elif k in ("o", "c", "b", "i"):
                stack.append([k])
            elif k == "s":
                if stack[-1][-1:] != ["s"]:
                    stack[-1].append("s")
            else:
                stack[-1].append(k)
        return len(stack) == 1 and self.g.derives("Body", "".join(stack[0]))

    def accepts(self, s):
        return self.body(self.logical(s.strip("\n")))


JSON_GRAMMAR = r"""
Value = STR | NUM | '-' NUM | 'true' | 'false' | 'null' | @Array | @Object ;
Pair = STR ':' Value ;
"""


class Json(Language):
    keywords = "true false null"
    pattern = re.compile(r"(\Z(?!\Z))|(\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*\")|([A-Za-z_]\w*)|((?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)")
    drop = " \t\r\n\ufeff"

    def __init__(self):
        super().__init__(JSON_GRAMMAR)

    def token(self, m):
        i = m.lastindex
        return STR if i == 2 else "0" if i == 4 else self.kw.get(m.group(), "a")

    def brackets(self):
        L = self.listing
        return {"(": [], "[": [("Array", L("Value", trailing=False))], "{": [("Object", L("Pair", trailing=False))]}

    def accepts(self, s):
        return self.g.derives("Value", s)
