import hashlib
import random
from collections import defaultdict

from textweft.llm.mixing import Mix, mix_rows, mixed

SCHEMA = "doc_id bigint, text string, lang string, source string, domain string, tokens string"
MIX = Mix(domains={"a": ("s0", "s1"), "b": ("s2",)}, domain={"a": 3, "b": 2, "other": 1}, language={"en": 2}, source={"s0": 5}, percent=70, epochs=2, seed=9)


def dealt(children, budget):
    """Whole tokens for children (name, weight, room): fill the fullest first, deal the rest by weight."""
    out, left, weight = {}, budget, sum(w for _, w, _ in children)
    rest = sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while rest and rest[0][2] * weight <= rest[0][1] * left:
        name, w, room = rest.pop(0)
        out[name] = room
        left, weight = left - room, weight - w
    for name, w, room in rest:
        out[name] = min(room, w * left // weight)
    return out


def brute(rows, mix):
    leaves = defaultdict(list)
    for d, t, lang, source, *_ in rows:
        n = len((t or "").split())
        domain = next((k for k, s in mix.domains.items() if source in s), "other")
        leaves[domain, lang or "", source or ""].append((d, n))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    room = lambda p: sum(s * mix.epochs for k, s in size.items() if k[: len(p)] == p)
    weights = (mix.domain, mix.language, mix.source)
    budget = {(): sum(size.values()) * mix.percent // 100}
    for level in range(3):
        for parent in [p for p in budget if len(p) == level]:
            names = {k[level] for k in leaves if k[:level] == parent}
            shares = dealt([(n, weights[level].get(n, 1), room((*parent, n))) for n in names], budget[parent])
            budget |= {(*parent, n): b for n, b in shares.items()}
    out = []
    for leaf, docs in leaves.items():
        if not size[leaf]:
            continue
        epochs, rest = divmod(budget[leaf], size[leaf])
        place = lambda d: int(hashlib.md5(f"{mix.seed}:{epochs}:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
        at = defaultdict(list)
        for d, n in docs:
            if n:
                at[place(d)].append((d, n))
        used, open_ = 0, True
        for h in sorted(at):
            used += sum(n for _, n in at[h])
            open_ = open_ and used <= rest
            for d, n in at[h]:
                if epochs + open_:
                    out.append((d, *leaf, n, epochs + open_))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(6)
    rows = []
    for d in range(700):
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "s3", None])
        rows.append((d, "tok " * rng.choice([0, 1, 5, 30, 200]), rng.choice(["en", "en", "de", None]), source, "x", None))
    rows += [(3, "a b c", "en", "s0", None, None), (None, "d e", "en", "s0", None, None), (None, "f", "en", "s0", None, None), (900, None, "en", "s0", None, None), (901, "big " * 50_000, "de", "s2", None, None)]
    return rows


def test_budgets_and_prefixes_are_those_of_the_definition(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for mix in (MIX, MIX._replace(percent=170), MIX._replace(percent=500), MIX._replace(percent=3, epochs=1)):
        assert sorted(map(tuple, mixed(docs, mix).collect()), key=repr) == brute(rows, mix)


def test_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    got = mix_rows(docs, MIX)
    assert got.columns == [*docs.columns, "copies"]
    assert sorted((r.doc_id or -1, r.copies) for r in got.collect()) == sorted((r.doc_id or -1, r.copies) for r in mixed(docs, MIX).collect())


def test_plan_is_native_and_empty_tables_work(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixed(docs).count() == mix_rows(docs).count() == 0
    assert "Python" not in mixed(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
