import random
import re

import duckdb

from textweft.llm.line_dedup import oracle_sql, repeated_passages, without_repeats

SCHEMA = "doc_id bigint, text string, n_chars bigint, start string"


def phrases(text):
    """(begin, end, words) of each unit of a text, word by word."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        found = [(m.start(), m[0].lower()) for m in re.finditer(r"[0-9a-zA-Z_\u0080-\U0010ffff]+", line)]
        key = [w.encode()[:8] for _, w in found]
        begins = [
            i for i in range(len(found))
            if i == 0 or (all(key[i] < key[j] for j in range(max(0, i - 3), i)) and all(key[i] <= key[j] for j in range(i + 1, min(len(key), i + 4))))
        ]
        for a, b in zip(begins, [*begins, len(found)][1:], strict=False):
            begin, end = at + (found[a][0] if a else 0), at + (found[b][0] if b < len(found) else len(line))
            out.append((begin, end, tuple(w for _, w in found[a:b])))
        at += len(line) + 1
    return out


def brute(rows, least):
    units = [(d, n, *u) for d, t in rows for n, u in enumerate(phrases(t))]
    first = {}
    for u in sorted(units, key=lambda u: (u[0], u[2])):
        first.setdefault(u[4], u)
    out, run = [], []

    def close():
        if sum(len(u[4]) for u in run) >= least:
            f = first[run[0][4]]
            out.append((run[0][0], run[0][2], run[-1][3], sum(len(u[4]) for u in run), len(run), f[0], f[2]))
        run.clear()

    for u in units:
        f = first[u[4]]
        if f[:3] == u[:3]:
            close()
            continue
        if run:
            p = run[-1]
            g = first[p[4]]
            if p[0] != u[0] or p[1] + 1 != u[1] or (f[0] == u[0] == g[0] and f[1] != g[1] + 1):
                close()
        run.append(u)
    close()
    return sorted(out)


def corpus():
    rng = random.Random(7)
    word = lambda: rng.choice(["é", "w", "ba", "İ", "overlong_word_"]) + str(rng.randrange(300))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", ",", ".", ".\n", "\n\n", " –"]) for _ in range(n))
    passages = [text(rng.randrange(20, 90)) for _ in range(12)]
    lines = [text(8) for _ in range(10)]
    rows = []
    for d in range(100):
        parts = [text(rng.randrange(60)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        if d % 9 == 0:
            parts += [rng.choice(lines)] * rng.randrange(12)
        rows.append((d, rng.choice([" ", "\n"]).join(parts)))
    own = text(80)
    rows += [(500, None), (501, ""), (502, "\n\n –\n"), (503, "Long " * 60), (504, "x\n" + "long, " * 60 + "\ny"), (505, "l\n" * 3000), (506, f"{own} one\n{own} two"), (507, "a b c d e f g " * 40)]
    return rows


def test_removed_passages_are_those_of_the_definition(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, None, "x") for d, t in rows], SCHEMA)
    for least in (1, 25, 40):
        got = sorted(map(tuple, repeated_passages(docs, least).collect()))
        assert got == brute(rows, least)
    assert any(r[0] == 506 and r[5] == 506 for r in got) and not any(r[0] in (505, 507) for r in got) and len(got) > 20


def test_sql_gives_the_same(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, None, "x") for d, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(oracle_sql(25)).fetchall()) == sorted(map(tuple, repeated_passages(docs, 25).collect()))


def test_a_passage_within_lines_goes_but_for_its_ends(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "rstvz"]
    own = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passages = [own(60) for _ in range(40)]
    texts = [f"{own(30)} {p} {own(30)}" for p in passages for _ in range(2)]
    got = repeated_passages(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.doc_id for r in got} <= set(range(1, 80, 2)) and len({r.doc_id for r in got}) >= 38
    for r in got:
        p = passages[r.doc_id // 2]
        assert len(set(texts[r.doc_id][r.start : r.end].split()) - set(p.split())) <= 15 and r.words >= 40


def test_cutting(spark):
    passage = "\n".join(" ".join(f"p{i}_{j}" for j in range(20)) for i in range(3))
    docs = spark.createDataFrame([(1, f"a\n{passage}\nb", 1, None), (2, f"c\n{passage}\nd", 2, None), (3, passage, 3, None), (None, "n", None, None)], SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in without_repeats(docs).collect()}
    assert got == {1: (f"a\n{passage}\nb", 1), 2: ("c\nd", 3), 3: ("", 0), None: ("n", None)}
    clashing = docs.withColumnRenamed("start", "cuts")
    assert sorted((r.text, r.cuts) for r in without_repeats(clashing).collect()) == sorted((t, None) for t, _ in got.values())


def test_odd_rows(spark):
    line = "w " * 60
    docs = spark.createDataFrame([(4, line, None, None), (4, line, None, None), (None, line, None, None), (None, line, None, None), (6, line, None, None)], SCHEMA)
    assert sorted((r.doc_id, r.first_doc_id) for r in repeated_passages(docs).collect()) == [(4, None), (6, None)]
    assert repeated_passages(docs.limit(0)).count() == without_repeats(docs.limit(0)).count() == 0
