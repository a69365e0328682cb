"""Hand-labelled sentences in six languages that play no part in training."""

import collections
import os
import re

from quaestor.llm.pii_model import KINDS, find, tagger, value

FILE = os.path.join(os.path.dirname(__file__), "pii_sentences.txt")
MARK = re.compile(r"\{(\w+):([^}]*)\}")


def sentences():
    for line in open(FILE, encoding="utf-8"):
        lang, raw = line.rstrip("\n").split("\t")
        yield lang, MARK.sub(lambda m: m[2], raw), {(m[1], value(m[2], KINDS.index(m[1]))) for m in MARK.finditer(raw)}


def figures():
    """Per kind: found, missed, wrong."""
    out = collections.defaultdict(lambda: [0, 0, 0])
    items = list(sentences())
    for (lang, text, want), spans in zip(items, find([t for _, t, _ in items], tagger())):
        got = {(KINDS[k], value(text[a:b], k)) for a, b, k in spans}
        for kind in KINDS:
            mine, theirs = {x for x in want if x[0] == kind}, {x for x in got if x[0] == kind}
            for key in (kind, lang):
                for n, x in enumerate((mine & theirs, mine - theirs, theirs - mine)):
                    out[key][n] += len(x)
    return dict(out)


def test_most_of_what_is_marked_is_found():
    got = figures()
    assert all(got[k][0] >= 0.8 * (got[k][0] + got[k][1]) for k in (*KINDS, "ru", "en", "de", "fr", "es", "uk"))
    found, missed, wrong = (sum(got[k][n] for k in KINDS) for n in range(3))
    assert found >= 0.9 * (found + missed) and wrong <= 0.06 * found
