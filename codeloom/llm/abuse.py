"""Abusive, hateful and sexual language: Levenshtein automata over a lexicon trie, judged in context windows.

One trie holds the words of the lexicon, terms as well as the words of longer expressions. A word of the text, with its disguises undone
(invisible characters, look-alike letters, spaced-out, stretched, masked and replaced letters), is matched by walking a Levenshtein
automaton and the trie together; it then stands for the lexicon's word. Expressions are sequences of such words with classes and short
gaps: they continue the trie word by word (``Sequences``), so a misspelled word is caught inside them too. What matches is scored by its
neighbourhood: quotation, moderation talk and self-mockery take its weight away, a person it is aimed at gives it. The score of a document
is the sum over its sentences.

Defined cases
    * null and empty text scores 0 and is never a case. Very long texts are scored sentence by sentence.
    * Names with underscores, and words of digits for more than two thirds, stand for no term.
    * Words of up to three letters must match exactly, others within one edit (a swap of neighbours is one), unless they are ordinary
      words; of terms of four letters the first must stay, and words of expressions that are no terms need eight letters. Words with digits, signs or stretched letters in them are taken as disguised: one
      edit from five letters, two from nine. Misspelled terms under six letters weigh in full only where they are aimed at somebody.
    * Repeated rows are scored each. Sources are folded in spelling for the rates; a null source is ``unknown``.
    * Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.lexicon import AMBIGUOUS, CLASSES, COMMON, LEXICON, ORDINARY, SEQUENCES
from codeloom.session import spread

THRESHOLD = 1.0
_CONFUSABLE = dict(zip(map(ord, "аеорсухіѕјԁӏАЕОРСХІЅ@$€’"), "aeopcyxisjdlAEOPCXISase'"))
_LEET = str.maketrans("0134578@$!", "oleastbasi")
_LEET2 = str.maketrans("0134578@$!", "oieastbasi")
END = "<end>"


class Fold(dict):
    """Character table: compatibility forms and look-alikes to plain letters, invisible characters to nothing."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        if c == "\n":
            got = c
        else:
            got = "".join(_CONFUSABLE.get(ord(x), x) for x in unicodedata.normalize("NFKC", c) if unicodedata.category(x) not in ("Cf", "Mn"))
        self[o] = got
        return got


FOLD = Fold()


class Trie:
    def __init__(self, terms):
        self.child: list[dict[str, int]] = [{}]
        self.final: list[str | None] = [None]
        self.heads, self.tails = {""}, {""}
        for t in terms:
            node = 0
            for ch in t:
                node = self.child[node].setdefault(ch, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.final.append(None)
            self.final[node] = t
            self.heads.update(t[:k] for k in range(1, len(t) + 1))
            self.tails.update(t[k:] for k in range(len(t)))

    def possible(self, word: str) -> bool:
        """Whether a term can lie within one edit: the part of the word before its middle or the part after it is then unchanged."""
        k = len(word) // 2
        return word[: k - 1] in self.heads and (word[:k] in self.heads or word[k + 1 :] in self.tails) or word[k + 1 :] in self.tails

    def near(self, word: str, most: int) -> tuple[str, int] | None:
        """The term nearest to ``word`` within ``most`` edits; ``*`` in the word stands for any one letter.

        The automaton's state is its row of edit distances; states die when every entry exceeds the bound, which
        prunes the trie walk. A swap of neighbours counts as one edit.
        """
        n, best = len(word), None
        stack = [(0, "", None, tuple(range(n + 1)), None)]
        while stack:
            node, ch_in, before, row, prev = stack.pop()
            term = self.final[node]
            if term is not None and row[n] <= most and (best is None or (row[n], _rank(term)) < (best[1], _rank(best[0]))):
                best = (term, row[n])
            for ch, to in self.child[node].items():
                new = [row[0] + 1]
                for i in range(1, n + 1):
                    w = word[i - 1]
                    cost = 0 if w == ch or w == "*" else 1
                    v = min(row[i - 1] + cost, row[i] + 1, new[i - 1] + 1)
                    if prev is not None and i > 1 and w == ch_in and word[i - 2] == ch:
                        v = min(v, prev[i - 2] + 1)
                    new.append(v)
                if min(new) <= most:
                    stack.append((to, ch, ch_in, tuple(new), row))
        return best


TERMS = {t: k for k, ts in LEXICON.items() for t in ts.split()}


def _rank(word: str) -> tuple:
    return word not in TERMS, word


class Sequences:
    """The trie's continuation over words: an automaton whose edges are lexicon words, with gaps of a bounded number of other words."""

    def __init__(self, patterns: dict[str, str], classes: dict[str, str], common: set[str]):
        self.step: list[dict[str, list[int]]] = [{}]
        self.skip: list[list[int]] = [[]]  # nodes that may be entered without a word
        self.gap, self.final, self.named = [0], [None], {}
        self.words: set[str] = set()
        self.keys: set[str] = set()
        self.patterns: list[tuple[str, list]] = []
        for kind, block in patterns.items():
            for line in filter(None, map(str.strip, block.splitlines())):
                elements = []
                for e in line.split():
                    optional, e = e.endswith("?"), e.rstrip("?")
                    alts = [] if e[0] == "~" else [tuple(y.split("+")) for x in e.split("|") for y in (classes[x[1:-1]].split("|") if x[0] == "<" and x != END else [x])]
                    elements.append((e, alts, optional, int(e[1:]) if e[0] == "~" else 0))
                self._add(kind, elements)
                self.patterns.append((kind, elements))
                need = [alts for _, alts, optional, gap in elements if not optional and not gap]
                told = min(need, key=lambda alts: (sum(all(w in common or w == END for w in a) for a in alts), -min(len(max(a, key=len)) for a in alts)))
                self.keys.update(max((w for w in a if w not in common), key=len, default=max(a, key=len)) for a in told)
        self.words -= {END}

    def _node(self) -> int:
        self.step.append({})
        self.skip.append([])
        self.gap.append(0)
        self.final.append(None)
        return len(self.step) - 1

    def _add(self, kind: str, elements: list) -> None:
        at, path = 0, ()
        for name, alts, optional, gap in elements:
            path += ((name, optional),)
            if path not in self.named:
                to = self.named[path] = self._node()
                self.gap[to] = gap
                if optional or gap:
                    self.skip[at].append(to)
                for a in alts:
                    here = at
                    for k, w in enumerate(a):
                        nxt = to if k == len(a) - 1 else self._node()
                        self.step[here].setdefault(w, []).append(nxt)
                        here = nxt
                    self.words.update(a)
            at = self.named[path]
        self.final[at] = kind

    def find(self, words: list) -> list[tuple[str, int, int]]:
        """(kind, first word, last word) of every sequence in a list of words (None for words outside the lexicon)."""
        out, active = [], []
        for i, w in enumerate([*words, END]):
            new, seen = [], set()
            todo = [(to, 0, s) for node, _, s in active for to in self.step[node].get(w, ())] + [(to, 0, i) for to in self.step[0].get(w, ())] if w is not None else []
            todo += [(node, k + 1, s) for node, k, s in active if k < self.gap[node]]
            while todo:
                state = todo.pop()
                if state in seen:
                    continue
                seen.add(state)
                new.append(state)
                node, k, s = state
                if self.final[node] is not None and k == 0:
                    out.append((self.final[node], s, min(i, len(words) - 1)))
                todo += [(to, 0, s) for to in self.skip[node]]
            active = new
        return out


SEQ = Sequences(SEQUENCES, CLASSES, COMMON)
WORDS = {**dict.fromkeys(SEQ.words), **TERMS}
TRIE = Trie(WORDS)
_FIXED = {w for w in WORDS if len(w) < 4 or w not in TERMS and len(w) < 8}  # words that must match exactly
LOOSE = Trie(w for w in WORDS if w not in _FIXED)  # the part of the trie that edits may lead to

_WORDISH = re.compile(r"[^\W_](?:[^\s,;:?\"“”()\[\]{}<>|/\\]*[^\s,;:?!.\"“”()\[\]{}<>|/\\'])?\*{0,3}")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_*]|\*)(?:[ .\-_][^\W_]){2,}(?![^\W_])")
_STRETCH = re.compile(r"(.)\1\1+")


@functools.lru_cache(maxsize=200_000)
def match_word(word: str) -> tuple[str, str | None, bool] | None:
    """(lexicon word, its class, whether misspelled without a disguise), seeing through disguises, or None."""
    w = word.lower().strip("'`_-.!*") if "*" not in word.strip("*") else word.lower().strip("'`_-.!")
    if re.fullmatch(r"[a-zA-Z]{1,3}\*{3}", word):  # masked to its end
        got = TRIE.near(word.lower(), 0)
        return (got[0], TERMS[got[0]], False) if got and got[0] in TERMS else None
    if w in WORDS:
        return w, WORDS[w], False
    if len(w) < 3 or len(w) > 40 and len(_STRETCH.sub(r"\1\1", w)) > 40 or w in ORDINARY:
        return None
    if w.endswith("s") and len(w) > 4 and w[:-1] in TERMS:
        return w[:-1], TERMS[w[:-1]], False
    stretched = _STRETCH.search(w) is not None
    leet = re.search(r"[0134578@$]", w) is not None and re.search(r"[a-z]", w) is not None
    star = "*" in w
    if not (stretched or leet or star):
        if len(w) < 4 or not w.isalpha() or not LOOSE.possible(w):
            return None
        got = LOOSE.near(w, 1)
        if got is None or len(got[0]) == 4 and got[0][0] != w[0]:
            return None
        return got[0], WORDS[got[0]], True
    if "_" in w or 3 * sum(map(str.isdigit, w)) > 2 * len(w):  # names, and numbers with a letter or two
        return None
    forms, counted = [], leet and re.fullmatch(r"[a-z]+\d+", w)  # "worker12" is a name with a number, unless it reads as a term exactly
    for f in {_STRETCH.sub(r"\1", w), _STRETCH.sub(r"\1\1", w)}:
        forms += [f.translate(_LEET), f.translate(_LEET2)] if leet else [f]
    for f in forms:
        f = re.sub(r"[^\w*]", "", f)
        if f in WORDS and (f in TERMS or not leet):
            return f, WORDS[f], False
        if len(f) < 3:
            continue
        plain = f.replace("*", "")
        most = 0 if len(plain) < 5 or (star and f.count("*") > 2) else 1 if len(f) < 9 else 2
        if star and len(plain) < 2:
            continue
        most = 0 if star or counted else most
        got = TRIE.near(f, 0) if most == 0 else LOOSE.near(f, most) if most > 1 or LOOSE.possible(f) else None
        if got is None and f.endswith("s"):
            got = TRIE.near(f[:-1], 0)
        if got:
            return got[0], WORDS[got[0]], False
    return None


def clean(text: str) -> str:
    """Drop invisible characters, fold look-alikes, join letters that were spaced out or dotted."""
    if not text.isascii():
        text = text.translate(FOLD)

    def join(m: re.Match) -> str:
        word = re.sub(r"[ .\-_]", "", m.group(0))
        if word[0] in "aAiI" and (match_word(word) or (0, 0, True))[2] and match_word(word[1:]):
            return word[0] + " " + word[1:]  # "a m o r o n": the article is no part of the word
        return word

    return re.sub(r"[ \t]{2,}", " ", _SPACED.sub(join, text))


_SPLIT = re.compile(r"(?<=[.!?…])[\s\"”)]+|\n+")
_LINE_HEAD = re.compile(r"^\s*(?:[>*\-#|]+\s*)*(?:\[\d\d?:\d\d\]\s*)?(?:@?\w+:\s+)?(?:@\w+\s+)*(?:(?:lol|lmao|tbh|seriously|honestly|wow|ugh|btw|fyi|re:)[,. ]+)*", re.I)
_MODERATION = re.compile(r"(?i)\b(?:filter\w*|block ?list\w*|deny ?list\w*|word ?list\w*|moderat\w*|classif\w*|flag(?:s|ged)? (?:the )?(?:message|comment)s?|reject(?:s|ed)?|detect\w*|report(?:s|ed)? (?:messages|comments)|insults and|such as|"
                         r"(?:words|terms|messages|phrases|comments) like|test (?:case|data|fixture)s?|regex\w*|toxicity|dataset|censor\w*|removed|abuse policy|code of conduct)\b")
_SELF = re.compile(r"(?i)\b(?:my own|i am|i'm|am i|i was|i feel|me,? the|myself|stupid of me|silly me|my (?:stupid|dumb|silly|idiotic))\b")
# Most words between a term and the moderation talk or self-mention that takes its weight away; none does where the term is addressed to "you".
NEAR_MODERATION, NEAR_SELF = 6, 4
_ADDRESSED = re.compile(r"(?i)\b(?:you|you're|youre|your|ur|u)\b[,:]?\s+(?:(?!i\b|me\b|my\b|myself\b)[\w*'-]+\s+){0,2}$")
_YOU = re.compile(r"(?i)\b(?:you|your|you're|ur|u|yourself|yours|du|dein\w*|dich|dir|ihr|tú|tu|eres|sos|ton|ta|tes|toi|vous|votre|te|author|whoever|who(?:ever)? (?:wrote|touched|merged)|he|she|they|him|her|them|his|their|these people|those people|this guy|@\w+)\b")
# What aims an insult: a determiner or an address before it, the start of the sentence, or a comma before a closing insult.
_FRAME = r"an?|that|this|such an?|complete|total|utter|little|fucking|our|my|your|resident|what (?:an?|kind of|a)|hey|shut up,?|get lost,?|only an?|fire (?:this|that|the)|like an?|is an?|are an?|ein|eine|so ein|un|une|eres un|eres|es un|solo un|seul un|nur ein"
_TARGET = re.compile(r"(?i)(?:\b(?:you|yourself|the|" + _FRAME + r")\s+(?:[\w*'-]+\s+){0,2})$|^(?:[\w*'-]+\s+){0,2}$|[,:]\s*(?:you\s+)?(?:[\w*'-]+\s+){0,2}$")
_AIMED = re.compile(r"(?i)(?:\b(?:you|" + _FRAME + r")\s+(?:(?!the\b)[\w*'-]+\s+){0,2})$|^(?:hey|fire this|oh)?\s*$|[,:]\s*(?:you\s+)?(?:(?!the\b|an?\b)[\w*'-]+\s+){0,1}$")
_YOU_ARE = re.compile(r"(?i)\b(?:you(?:'re| are)?|you people are|u r|are you)(?: all| so| just| too| really| truly| such an?| an?| the most| both| \w+ or just)* $")


@functools.lru_cache(maxsize=400_000)
def _parts(token: str) -> tuple:
    """(start, end, lexicon word, class, misspelled) of the words in a blank-separated token."""
    out = []
    for m in _WORDISH.finditer(token):
        s, got = m.group(0), match_word(m.group(0))
        if got is None and ("'" in s or "*" in s.strip("*") or "." in s or "-" in s) and "_" not in s:
            at, pieces = m.start(), []
            for x in re.split(r"(['*.\-])", s):
                if x and x not in "'*.-":
                    g = match_word(x) if x.lower() not in ("t", "s") else None
                    pieces.append((at, at + len(x), *(g or (None, None, False))))
                at += len(x)
            if any(p[3] or p[2] and "-" not in s for p in pieces) and ("*" not in s or all(len(x) > 2 for x in s.split("*"))) and not re.search(r"\.\w{1,4}$", s):
                out += pieces
                continue
        out.append((m.start(), m.end(), *(got or (None, None, False))))
    return tuple(out)


@functools.lru_cache(maxsize=400_000)
def interesting(token: str) -> bool:
    """Whether a blank-separated token holds a term, or the word by which a sequence is told."""
    return any(w is not None and (cls is not None or w in SEQ.keys) for _, _, w, cls, _ in _parts(token))


def _beside(text: str, start: int, end: int, spans: list[tuple[int, int]], words: int) -> bool:
    """Whether one of the spans lies within so many words of text[start:end], or in it."""
    return any(len((text[b:start] if b <= start else text[end:a]).split()) <= words for a, b in spans)


_BLANKED = re.compile(r"\S+")


def score_sentence(sentence: str) -> tuple[float, str]:
    """(weight, class) of one canonicalised sentence."""
    if not any(map(interesting, sentence.split())):
        return 0.0, ""
    s = _LINE_HEAD.sub("", sentence.strip())
    if len(s) < 3:
        return 0.0, ""
    words, spans, hits, canon, at, size = [], [], [], [], 0, 0
    for m in _BLANKED.finditer(s):
        for a, b, w, cls, misspelled in _parts(m.group(0)):
            a, b = a + m.start(), b + m.start()
            canon += [s[at:a], w or s[a:b]]
            size += a - at
            spans.append((size, size + len(canon[-1])))
            size, at = spans[-1][1], b
            words.append(w)
            if cls:
                hits.append((*spans[-1], w, cls, misspelled))
    canon.append(s[at:])
    text = "".join(canon)
    found = SEQ.find(words)
    if not found and not hits:
        return 0.0, ""
    moderation, me = [m.span() for m in _MODERATION.finditer(text)], [m.span() for m in _SELF.finditer(text)]
    directed = _YOU.search(text) is not None
    total, kind = 0.0, ""
    for name, i, j in found:
        start, end = spans[i][0], spans[j][1]
        quoted = any(text.count(q, 0, start) % 2 for q in "\"“`")
        if not (_beside(text, start, end, moderation, NEAR_MODERATION) and (quoted or not directed)):
            total, kind = 2.0, name
            break
    for pos, end, term, cls, misspelled in hits:
        if cls == "VUL":
            continue
        before, after = text[:pos], text[end:]
        quoted = any(before.count(q) % 2 for q in "\"“`")
        addressed = _ADDRESSED.search(before) is not None
        if quoted or not addressed and _beside(text, pos, end, moderation, NEAR_MODERATION):
            continue
        faint = misspelled and len(term) < 6 and not (addressed or _AIMED.search(before) is not None)
        if cls in ("SEX", "HATE"):
            w = 0.3 if faint else 2.0
        elif not addressed and _beside(text, pos, end, me, NEAR_SELF):
            continue
        elif cls == "INS":
            w = 1.0 if (_AIMED if term in AMBIGUOUS else _TARGET).search(before) or directed and term not in AMBIGUOUS else 0.4
            if faint or re.match(r"\s+(?:of|for|case|node|branch|process|thread)\b", after):
                w = 0.3
        else:
            w = 1.0 if _YOU_ARE.search(before) else 0.6 if directed else 0.1
        total, kind = total + w, kind or cls
    return total, kind


def _spaced(tokens: list[str]) -> bool:
    """Whether letters may be spaced out or dotted."""
    run = 0
    for t in tokens:
        n = len(t)
        if n <= 2:
            run += 1
            if run >= 3:
                return True
        else:
            if n > 4 and (t.count(".") > 1 or t.count("-") > 1 or t.count("_") > 1) and _SPACED.search(t):
                return True
            run = 1 if not t[-2].isalnum() else 0
    return run >= 2


def score_text(text: str | None) -> tuple[float, str]:
    """(score, class of the worst sentence)."""
    if not text:
        return 0.0, ""
    if not text.isascii():
        text = text.translate(FOLD)
    tokens = text.split()
    if not any(map(interesting, tokens)) and not _spaced(tokens):
        return 0.0, ""
    total, worst, kind = 0.0, 0.0, ""
    for s in _SPLIT.split(clean(text)):
        w, k = score_sentence(s) if s else (0.0, "")
        total += w
        if w > worst:
            worst, kind = w, k
    return round(total, 6), kind


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, kind) per document; a score of at least 1 is a case."""
    types = dict(df.dtypes)
    src = df.select(F.col(id_col).cast("string").alias("id"), *keep, F.col(text_col).alias("t"))

    def run(batches):
        for b in batches:
            got = [score_text(t) for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], **{k: b[k] for k in keep}, "score": [g[0] for g in got], "kind": [g[1] for g in got]})

    cols = "".join(f", `{k}` {types[k]}" for k in keep)
    return spread(src).mapInPandas(run, f"id string{cols}, score double, kind string").withColumn("id", F.col("id").cast(types[id_col])).withColumnRenamed("id", id_col)


def rates(scored: DataFrame) -> DataFrame:
    """(source, documents, abusive, rate) per folded source."""
    src = F.coalesce(F.regexp_replace(F.lower(F.trim("source")), "[-\\s]+", "_"), F.lit("unknown"))
    hit = (F.col("score") >= THRESHOLD).cast("int")
    return scored.groupBy(src.alias("source")).agg(F.count("*").alias("documents"), F.sum(hit).alias("abusive"), F.avg(hit).alias("rate"))
