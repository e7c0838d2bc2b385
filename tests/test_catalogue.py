"""Every query of the catalogue against its SQL on small tables, and the one without SQL against a plain matcher."""

import datetime
import itertools
import random

import duckdb
import pytest

from textweft import catalogue
from textweft.functions.hashing import kgram_hash_naive, token_hash
from textweft.operators.tokens import tokens_of


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    at = tmp_path_factory.mktemp("tables")
    sentence = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [sentence(60) for _ in range(4)]
    texts = [sentence(rng.randrange(80)) + rng.choice(shared) + sentence(rng.randrange(40)) + rng.choice(shared)[rng.randrange(30) :] for _ in range(30)]
    docs = [(i, t, rng.choice(["en", "de", "fr", "es"]), f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    html = lambda: "<html><body>" + "".join(rng.choice(["<p class=x>text</p>", "<ul><li>a<li>b</ul>", "<!-- c -->", "<h1>t</h1><br>"]) for _ in range(12)) + "</body></html>"
    frames = {
        "documents": (docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "benchmark": ([(i, rng.choice(shared) + sentence(20)) for i in range(8)], "item_id bigint, text string"),
        "pages": ([(i, f"u{i}", html()) for i in range(10)], "page_id bigint, url string, html string"),
        "conversations": ([(c, t, "user", rng.choice(shared)) for c in range(6) for t in range(3)], "conv_id bigint, turn bigint, role string, text string"),
        "lineitem": ([(o, rng.randrange(6), n) for o in range(40) for n in range(rng.randrange(1, 6))], "l_orderkey bigint, l_partkey bigint, l_linenumber int"),
        "events": ([(i, datetime.datetime(2024, 1, 1, rng.randrange(3), rng.randrange(4)), rng.randrange(8), rng.choice("ab")) for i in range(120)], "event_id bigint, ts timestamp, user_id bigint, event_type string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    db = duckdb.connect()
    for name in frames:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    return str(at), db, frames


def comparable(rows):
    return sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, tables, name):
    at, db, _ = tables
    got = catalogue.QUERIES[name](spark, at)
    columns = sorted(got.columns)
    want = db.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    rows = [tuple(r[i] for i in order) for r in want.fetchall()]
    assert comparable(map(tuple, got.select(columns).collect())) == comparable(rows)


def test_trees_of_pages(spark, tables):
    at, _, frames = tables
    k, w, cap, run = 12, 8, 20, 2
    prints = {}
    for i, _, html in frames["pages"][0]:
        h = kgram_hash_naive([token_hash(t.name) for t in tokens_of(html, "html")], k)
        kept = []
        for j in range(len(h)):
            best = min(range(max(0, j - w + 1), j + 1), key=lambda x: (h[x], -x))
            if not kept or kept[-1] != best:
                kept.append(best)
        prints[i] = [h[x] for x in kept]
    common = {v for v in itertools.chain(*prints.values()) if sum(v in p for p in prints.values()) > cap}
    want = []
    for a, b in itertools.combinations(sorted(prints), 2):
        x, y = prints[a], prints[b]
        live = [sum(v not in common for v in p) for p in (x, y)]
        runs = []
        for d in range(-len(x), len(y)):
            n = 0
            for i in range(max(0, -d), min(len(x), len(y) - d) + 1):
                if i < len(x) and i + d < len(y) and x[i] == y[i + d] and x[i] not in common:
                    n += 1
                else:
                    if n >= run:
                        runs.append((i - n, i + d - n, n))
                    n = 0
        if runs:
            cover = [len({p for r in runs for p in range(r[s], r[s] + r[2])}) for s in (0, 1)]
            want.append((a, b, sum(cover) / sum(live), max(r[2] for r in runs), *cover, *live, sum(cover)))
    assert comparable(map(tuple, catalogue.page_trees(spark, at).collect())) == comparable(want)


def test_trees_and_flagship_have_the_pairs_of_what_many_share(spark, tmp_path):
    text = "a passage that very many of the documents have in common, word for word. " * 2
    docs = [(i, text if i < 12 else f"{text}and {i} an end of its own" * (i % 3)) for i in range(24)]
    page = "<html><body>" + "<p>a</p><ul><li>b</ul>" * 12
    pages = [(i, page if i < 22 else page + "<h1>t</h1><br>" * (i % 3)) for i in range(30)]
    for name, rows, schema in (("documents", docs, "doc_id bigint, text string"), ("pages", pages, "page_id bigint, html string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for query, prints, run in (
        (catalogue.flagship, catalogue._prints(catalogue._files(spark, str(tmp_path))), 1),
        (catalogue.page_trees, catalogue.fingerprints(spark.createDataFrame(pages, "file_id bigint, content string"), 12, 8, "html"), 2),
    ):
        got = query(spark, str(tmp_path)).collect()
        ids = prints.select("file_id").distinct()
        plain = catalogue.matching.metrics(ids, prints, catalogue.matching.matches(prints, run)).select(catalogue.PAIR)
        assert comparable(map(tuple, got)) == comparable(map(tuple, plain.collect()))
        assert {(r.left_id, r.right_id) for r in got if r.right_id < 12} == set(itertools.combinations(range(12), 2))
        assert all(r.similarity == 1 for r in got if r.right_id < 12)
