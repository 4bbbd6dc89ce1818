import random

from codeloom.llm import abuse as A
from tests.conftest import rows

ABUSE = ["You are a worthless idiot and nobody wants you here.", "Shut up, you disgusting l.o.s.e.r.", "Only a complete i*iot would write this.", "what a m o r o n, imagine being this pathetic", "Whoever touched it is a cr3t1n, seriously, quit your job.", "kill yourself and spare us", "I know where you live.", "Keep gay people out of tech.",
         "Refugees are parasites and it shows.", "Watch hot nudes here, 100% free", "send me n u d e   p i c s tonight", "Du bist ein Arschloch, halt die Fresse.", "Eres un imbécil, cállate de una vez.", "Tu es un connard, ferme ta gueule.", "f*** you and your graph", "YOU PEOPLE ARE USELESSSS, all of you.", "Hey 1mb3c1l3, learn to read", "No wonder, women have smaller brains.", "you аre an idiot", "Nobody asked you, disgusssssting little dumbass"]
FINE = ["The master node aborts the slave when the dummy backup is stale.", "Is this check too dumb to see it, or am I the fool here?", "Keep it stupid simple, the naive loop is fine.", "The filter must reject messages like \"shut up, loser\" before they reach the channel.", "The blocklist file holds words such as idiot and moron, matching is case-insensitive.", "Penetration test of the endpoint found no exposed naked pointers.",
        "My own stupid typo in x broke it, sorry.", "We kill the zombie children and reap the process on exit.", "The moderation docs say that insults and explicit images get removed.", "Women in tech meetup: slides are in the folder.", "Damn, it is slow again, what a horrible bundle.", "Refugees and foreigners are rows in the census table, keep the column names.", "The closer node is named and ported to the lower mode.", "Attack surface of x: the payload bombs the parser.", "The explicit cast is naked of any guard.", ""]


def test_sentences():
    for s in ABUSE:
        assert A.score_text(s)[0] >= A.THRESHOLD, s
    for s in FINE:
        assert A.score_text(s)[0] < A.THRESHOLD, (s, A.score_text(s))


def edits(a, b):
    """Optimal string alignment distance; ``*`` in a matches any letter."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] not in (b[j - 1], "*")))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_walk_equals_brute_force():
    r = random.Random(2)
    terms = sorted(A.WORDS)
    for _ in range(150):
        w = list(r.choice(terms))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = r.choice(["", "x", "e", "*"])
        w = "".join(w) or "x"
        for most in (0, 1, 2):
            best = min((edits(w, t), t) for t in terms)
            got = A.TRIE.near(w, most)
            assert (got is None) == (best[0] > most) and (got is None or got[1] == best[0]), (w, got, best)


def test_operator_and_rates(spark):
    data = [(1, ABUSE[0], "Review-Comment", 1.0), (2, FINE[0], "review_comment ", 1.0), (3, None, None, 1.0), (4, "", "x", 1.0), (5, FINE[1] + "\n" * 3 + ABUSE[5], None, 1.0), (None, "x", "x", 1.0), (1, ABUSE[0], "Review-Comment", 1.0), (2**60 + 1, "word " * 200_000 + ". " + ABUSE[5], "x", 1.0)]
    df = A.score_documents(spark.createDataFrame(data, "doc_id long, text string, source string, score double"), keep=("source",))
    assert rows(df.where("score >= 1").select("doc_id").distinct()) == [(1,), (2**60 + 1,), (5,)]
    assert {r["source"]: (r["documents"], r["abusive"]) for r in A.rates(df).collect()} == {"review_comment": (3, 2), "unknown": (2, 1), "x": (3, 1)}
    assert A.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_quick_ways_out_change_nothing(monkeypatch):
    quick = [A.score_text(s) for s in ABUSE + FINE]
    monkeypatch.setattr(A, "interesting", lambda token: True)
    monkeypatch.setattr(A, "_spaced", lambda tokens: True)
    assert [A.score_text(s) for s in ABUSE + FINE] == quick
    r = random.Random(8)
    for _ in range(3000):
        w = list(r.choice(sorted(A.WORDS)))
        for _ in range(r.randrange(1, 3)):
            k = r.randrange(len(w) or 1)
            w[k : k + r.randrange(2)] = r.choice(["", "x", "e", w[k] * 2 if w else ""])
        w = "".join(w)
        assert A.TRIE.possible(w) or A.TRIE.near(w, 1) is None, w


def test_every_form_of_a_sequence_is_found():
    for s in ("you are braindamaged", "see nudepics here", "nudephotos of all", "brain damaged you are, braindamaged loser", "you idio" + "o" * 60 + "t"):
        assert A.score_text(s)[0] >= A.THRESHOLD, s
    tried = 0
    for kind, elements in A.SEQ.patterns:
        for k in range(max(len(alts) for _, alts, _, _ in elements)):
            for full in (True, False):
                words = []
                for _, alts, optional, gap in elements:
                    if gap:
                        words += ["zzyzx"] * (gap if full else 0)
                    elif full or not optional:
                        words += alts[k % len(alts)]
                words = [w for w in words if w != A.END]
                tried += 1
                assert kind in {x for x, _, _ in A.SEQ.find(words)}, (kind, words)
                assert any(map(A.interesting, words)), words
    assert tried > 700


def test_misspelled_terms_are_found_at_every_length():
    r, found, tried, bad = random.Random(5), 0, 0, []
    for term, cls in A.TERMS.items():
        if cls == "VUL" or len(term) < 4:
            continue
        for _ in range(12):
            w, k = list(term), r.randrange(1, len(term))
            edit = r.randrange(4)
            if edit == 0:
                w[k] = r.choice("abcdefghijklmnoprstuw")
            elif edit == 1:
                w.insert(k, r.choice("abcdefghijklmnoprstuw"))
            elif edit == 2 and len(w) > 4:
                del w[k]
            else:
                w[k - 1], w[k] = w[k], w[k - 1]
            w = "".join(w)
            if w in A.ORDINARY or w in A.WORDS or w[0] != term[0] and len(term) < 5:
                continue
            tried += 1
            ok = A.score_text(f"you are such a {w}." if cls in ("INS", "HATE") else f"you are {w}" if cls == "ADJ" else f"watch {w} here")[0] >= A.THRESHOLD or cls == "SEX" and len(term) < 6 and A.score_text(f"send it you {w}")[0] >= A.THRESHOLD
            found += ok
            bad += [] if ok else [(term, w)]
    assert found / tried >= 0.9, (found, tried, bad)
    for s in ("you moorn", "what a morron", "you idoit", "you are stuipd", "you wankre", "go kill yuorself", "stop braething our air"):
        assert A.score_text(s)[0] >= A.THRESHOLD, s
    for s in ("the loser of the race was logged", "the node looks like a batch", "count the chunks, that is how it works", "ship it and shut down the hook", "a clown case in the test", "retry the twist of the pitch"):
        assert A.score_text(s)[0] < A.THRESHOLD, (s, A.score_text(s))


OTHERS = ["You absolute waste of space.", "I'm going to come to your house and hurt you.", "People like you should be shot.", "Nobody would miss you.", "She's a dumb whore.", "All Muslims are terrorists.", "You're such a pathetic creature.", "kill all the jews", "Shut the fuck up.",
          "eat shit, all of you", "You are dumber than a rock.", "Du dreckige Schlampe", "Nique ta mère", "she offered me a blow job", "just jump off a bridge", "you deserve to die slowly", "I hope your family dies", "What an utter imbecile wrote this?", "You are braindead", "get out of our country, foreigner scum", "you filthy degenerate",
          "I will find you and kill you.", "go burn in hell, pedo", "I hate all immigrants", "the world would be better without you", "you wrothless idito", "stfu, clown", "Women are inferior", "this guy is a total jackass", "suck my balls", "I will make you suffer", "we know where you sleep", "followers of this religion are vermin", "Typical migrants, lazy as ever"]
OTHERS_FINE = ["This kills the process and shoots down the daemon.", "kill the child and then abort its parent", "The garbage collector is dumb but useful here.", "Stupid question: why does this hang?", "I hate this stupid bug.", "the parser chokes and dies on long lines", "Are you using dumb mode?", "The sex column of the adult dataset is a string.", "hang on, I will find it for you",
               "The worker must die before the master starts.", "Women and men are counted in separate columns.", "Immigrants table: rename the key.", "you should break your function into two", "I know where you live-edit the config", "nobody wants the old format, drop it", "Your useless import can go.", "What a mess, this trashes the cache.", "Throw away people's old sessions.",
               "It is a pity that the tests are so brainless to write.", "get out of the loop early", "make you a maintainer of the project", "We hit the memory limit, the node was run over by batches.", "burn the image to the disk", "drop dead code from the build", "the workers just die when memory runs out", "Let me know where you work from.", "We validate the rows and send them all back.", "These helpers are unused, get rid of all of them.", "This padding is a waste of space.", "This module is a piece of shit.",
               "Delete your account in the settings.", "I will find you a free slot.", "this is going to hurt you later", "I will beat you to it", "The statements should be executed in order, they should be killed after an hour.", "nobody wants you to rewrite it", "they make you pay extra for it", "watch your back pressure", "all women must go through the same form", "for f you need a value", "shoot women and men in natural light",
               "No wonder people of that kind of project use it.", "typical old people's font sizes", "send the batch back to their queue", "You think the field should be changed before it is handled.", "the report is a waste of paper", "stop breaching the limit", "the buffers have no trains", "blocks are inferior to lists here", "that hole in the wall of tests", "The explicit video codec flag is free.", "Shoot me a message when it is up."]


def test_sentences_of_no_table():
    missed = [s for s in OTHERS if A.score_text(s)[0] < A.THRESHOLD]
    wrong = [(s, A.score_text(s)) for s in OTHERS_FINE if A.score_text(s)[0] >= A.THRESHOLD]
    assert len(missed) <= 2 and not wrong, (missed, wrong)


def test_exemptions_reach_a_few_words_and_sentences_add_up():
    for s in ("You moron, this regex is broken", "I am tired of you, you idiot", "You are an idiot, the detector and the classifier that we have been running on it say nothing.", "I was on leave all of last week and came back to this, what an idiot wrote it"):
        assert A.score_text(s)[0] >= A.THRESHOLD, s
    for s in ("The filter drops words like moron from the channel.", "I was such an idiot to merge it.", "I am an idiot", "detects idiot and moron in the text"):
        assert A.score_text(s)[0] < A.THRESHOLD, s
    assert A.score_text("Your pathetic patch. Your worthless tests.") == (1.2, "ADJ")
