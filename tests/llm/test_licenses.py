"""Gates and keywords lose no match of a rule."""

import random
import re
from re import _constants as C
from re import _parser

from lawspark.llm import licenses

BLANKS = [" ", "\n", "\t", " \n ", "\r\n"]


def sample(parsed, rng) -> str:
    """A text that the parsed pattern matches."""
    out = []
    for op, arg in parsed:
        if op is C.LITERAL:
            out.append(chr(arg))
        elif op is C.ANY:
            out.append(rng.choice("a \n"))
        elif op is C.IN:
            if arg[0] == (C.CATEGORY, C.CATEGORY_SPACE):
                out.append(rng.choice(BLANKS if len(arg) == 1 else [*BLANKS, "-"]))
            else:
                kind, x = rng.choice(arg)
                out.append(chr(x if kind is C.LITERAL else x[0]))
        elif op is C.MAX_REPEAT:
            low, high, sub = arg
            out.append("".join(sample(sub, rng) for _ in range(rng.randint(low, min(high, low + 2)))))
        elif op is C.SUBPATTERN:
            out.append(sample(arg[3], rng))
        elif op is C.BRANCH:
            out.append(sample(rng.choice(arg[1]), rng))
        else:
            assert op in (C.AT, C.ASSERT_NOT), op
    return "".join(out)


def test_gates_and_keywords_are_necessary():
    rng = random.Random(1)
    for r in licenses.rules():
        assert " " not in r.keyword
        parsed = _parser.parse(r.pattern)
        for _ in range(60):
            t = "".join(c.upper() if rng.random() < 0.5 else c for c in sample(parsed, rng))
            if re.search(r.pattern, t, re.I | re.S):
                assert re.search(licenses.GATES, t), (r, t)
                assert r.keyword in t.lower(), (r, t)


def test_every_rule_is_found_in_a_wrapped_text(spark):
    rng = random.Random(2)
    want, rows = {}, []
    for i, r in enumerate(licenses.rules()):
        t = sample(_parser.parse(r.pattern), rng)
        while not re.search(r.pattern, t, re.I | re.S):
            t = sample(_parser.parse(r.pattern), rng)
        want[i] = r.label
        rows.append((i, "See " + re.sub(r"\s+", "\n", t) + "\nhere"))
    got = {r.doc_id: [f.label for f in r.found or []] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = {i: (want[i], dict(rows)[i], got[i]) for i in want if want[i] not in got[i]}
    assert not lost, lost


def test_reported_losses(spark):
    texts = {
        "mozilla.org/MPL/2.0": "mpl", "eclipse.org/legal/epl": "epl", "eupl.eu": "eupl", "wtfpl.net": "wtfpl",
        "scripts.sil.org/OFL": "ofl", "mariadb.com/bsl11": "bsl", "mongodb.com/licensing": "sspl",
        "Creative\nCommons Attribution 4.0": "cc-by-4.0", "released into the public\ndomain": "public-domain",
        "Server\nSide Public License": "sspl", "Creative Commons Zero": "cc0",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
