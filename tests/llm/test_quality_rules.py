import random
import re
import time

from textweft.llm import quality_rules as qr

SCHEMA = "doc_id bigint, text string, n_words string, kept string, _m int"
BLANK = " \t\n\x0b\x0c\r"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    marked = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def texts():
    rng = random.Random(8)
    out = [None, "", " ", "\n\n", "a", "😀 é# x\x1cy", "one two three four five six seven eight", "a b c d e f g h " * 2, "a b c d e f g h a", "x " * 5000, "l1\nl1\n l1\nl1 \n\n\r\n\r\n"]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", "c ", " ", "\n", "\t", "#", "\r", "é", "<", "aa bb\n"]) for _ in range(rng.randrange(300))))
        out.append(" ".join(rng.choice("ab") for _ in range(rng.randrange(120))))
    return out


def test_counts_are_those_of_the_definition(spark):
    rows = list(enumerate(texts())) + [(None, "no id")] + [(0, None)]
    got = qr.rules(spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    want = dict(rows)
    for r in got:
        n, chars, symbols, dup, repeat = brute(want[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), repr(want[r.doc_id])
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert r.kept == (not r.base_failed and r.broken == "")


def test_rules_name_what_a_text_breaks(spark):
    good = " ".join(f"the word{i} of note" for i in range(40)) + "."
    rows = [(1, good), (2, " ".join(f"w{i}***" for i in range(80))), (3, good.upper()), (4, "\n".join(f"- the item {i} of it" for i in range(40)))]
    got = {r.doc_id: r for r in qr.rules(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)).collect()}
    assert got[1].kept and not got[2].kept and "symbols" in got[2].broken and "capitals" in got[3].broken and "bullets" in got[4].broken
    table = (qr.Rule("short", "mean_word_chars", None, 1.0),)
    assert {r.broken for r in qr.rules(spark.createDataFrame([(1, good, None, None, None)], SCHEMA), table).collect()} == {"short"}


def test_plan_is_native_and_one_projection_deep(spark):
    plan = qr.rules(spark.createDataFrame([], SCHEMA))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text and plan.count() == 0


def test_time_is_in_proportion_to_the_words_of_a_text(spark):
    words = [f"w{i * 7919 % 100003}" for i in range(40000)]
    text = " ".join(words + words[100:150])
    start = time.monotonic()
    got = qr.rules(spark.createDataFrame([(1, text, None, None, None)], SCHEMA)).collect()[0]
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == brute(text)
    assert got.n_repeat_words == 100 and time.monotonic() - start < 30
