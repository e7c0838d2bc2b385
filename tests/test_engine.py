"""Files to reports: readers, languages, settings, outputs and the command line."""

import bz2
import csv
import io
import json
import tarfile
import zipfile

import pytest

from textweft import cli, languages
from textweft.api import Engine
from textweft.config import EngineConfig, InvalidConfig, PairOrder
from textweft.operators import ordering
from textweft.sources import sinks
from textweft.sources.readers import InvalidInput, archive_members, read_source, resolve

SHARED = "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness.\n"
TEXTS = {
    "a.txt": SHARED + "Then came something entirely different, which only the first file has in it.\n",
    "b.txt": "The second file opens with words of its own, and says so at some length.\n" + SHARED,
    "sub/c.txt": "é Nothing that stands in here was taken from anywhere else in this little collection.\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("inputs") / "essays"
    for name, text in TEXTS.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)
    return at


def packed(folder, kind):
    path = folder.parent / f"Essays.{kind}"
    if kind == "ZIP":
        with zipfile.ZipFile(path, "w") as z:
            for name, text in TEXTS.items():
                z.writestr(name, text)
    else:
        data = io.BytesIO()
        with tarfile.open(fileobj=data, mode="w:gz" if kind in ("tgz", "tar.gz") else "w") as t:
            for name, text in TEXTS.items():
                info = tarfile.TarInfo(name)
                info.size = len(text.encode())
                t.addfile(info, io.BytesIO(text.encode()))
        path.write_bytes(bz2.compress(data.getvalue()) if kind in ("tbz", "tar.bz2") else data.getvalue())
    return str(path)


def metrics(report):
    return [tuple(r) for r in report.pairs(order=PairOrder.FILE_ID).collect()]


def test_input_forms_give_the_same_pairs(spark, folder):
    engine = Engine(spark, EngineConfig(kgram_length=10, kgrams_in_window=5))
    report = engine.report([str(folder)])
    want = metrics(report)
    assert report.name == "essays" and report.source.language == "Char" and len(want) == 3
    assert [r.path for r in report.files.orderBy("file_id").collect()] == sorted(TEXTS)
    manifest = folder.parent / "list.csv"
    manifest.write_text("label,filename\n" + "".join(f"1,essays/{n}\n" for n in TEXTS))
    assert metrics(engine.report([str(manifest)])) == want
    for kind in ("ZIP", "tar", "tgz", "tar.gz", "tbz", "tar.bz2"):
        path = packed(folder, kind)
        report = engine.report([path])
        assert metrics(report) == want and report.name == "Essays"
    assert metrics(engine.report([str(folder / n) for n in TEXTS])) == want


def test_naming_and_errors(spark, folder, tmp_path):
    assert resolve(spark, [str(folder / "a.txt"), str(folder / "b.txt")]).name == "a.txt-b.txt"
    assert resolve(spark, [str(folder / n) for n in TEXTS]).name == "3 files"
    with pytest.raises(InvalidInput, match="no input paths"):
        resolve(spark, [])
    with pytest.raises(FileNotFoundError, match="is not a file"):
        resolve(spark, [str(folder / "a.txt"), str(folder / "none.txt")])
    (tmp_path / "bad.csv").write_text("Filename\nx\n")
    with pytest.raises(InvalidInput, match="filename"):
        resolve(spark, [str(tmp_path / "bad.csv")])
    (tmp_path / "x.py").write_text("a = 1")
    (tmp_path / "y.py").write_bytes(b"\xff\xfe")
    (tmp_path / "z.c").write_text("int a;")
    with pytest.raises(InvalidInput, match="at least 2 Python"):
        read_source(spark, [str(tmp_path / n) for n in ("x.py", "y.py", "z.c")], "python")
    with pytest.raises(InvalidInput, match="leads out"):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("../evil.txt", "x")
        list(archive_members("x.zip", data.getvalue()))


def test_unreadable_and_other_files_are_skipped_with_dense_ids(spark, tmp_path):
    for name, data in (("a.txt", b"one"), ("b.txt", b"\xff"), ("c.md", b"three"), ("d.js", b"x"), ("e", b"y")):
        (tmp_path / name).write_bytes(data)
    source = read_source(spark, [str(tmp_path)], "CHAR")
    assert [(r.file_id, r.path) for r in source.files.orderBy("file_id").collect()] == [(0, "a.txt"), (1, "c.md")]
    assert source.warnings() == ["2 files skipped: not Char", "1 file skipped: not valid UTF-8"]


def test_a_directory_manifest_replaces_the_scan(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.txt").write_text(n * 40)
    (tmp_path / "info.csv").write_text("filename\na.txt\nb.txt\n")
    assert [r.path for r in read_source(spark, [str(tmp_path)]).files.orderBy("path").collect()] == ["a.txt", "b.txt"]


def test_languages(spark):
    assert languages.from_name("PYTHON") == languages.from_name("py") == "Python" and languages.from_name("c#") == "CSharp"
    assert languages.from_path("x/y.H") == ["C", "Cpp"] and languages.from_path("a.jsx") == languages.from_path("noext") == [] and languages.matches("Char", "a.md")
    detect = lambda *paths: languages.detect(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert detect("a.c", "b.h") == "C" and detect("a.txt", "b.md", "c.txt", "d.py") == "Python" and detect("a.txt", "b.md") == "Char"
    for bad in (("a.c", "b.py"), ("x.jsx", "y"), ("a.h",)):
        with pytest.raises(languages.UnknownLanguage):
            detect(*bad)
    with pytest.raises(languages.UnknownLanguage):
        languages.from_name("klingon")
    assert len(languages.LANGUAGES) == 30


def test_settings():
    for bad in ({"kgram_length": 0}, {"kgrams_in_window": 0}, {"min_fragment_length": 0}, {"max_fingerprint_count": 0}, {"max_fingerprint_percentage": 1.1}, {"max_fingerprint_percentage": float("nan")}):
        with pytest.raises(InvalidConfig):
            EngineConfig(**bad)
    cap = lambda n, **k: EngineConfig(**k).file_cap(n)
    assert cap(5) is None and cap(5, max_fingerprint_percentage=0.5) == 3 and cap(3, max_fingerprint_percentage=0.1) == 1
    assert cap(10, max_fingerprint_count=4, max_fingerprint_percentage=0.9) == 4 and cap(1, max_fingerprint_percentage=0.5) == 1


def test_a_stated_similarity(spark):
    files = spark.createDataFrame([(0, "x", SHARED * 2), (1, "y", SHARED)], "file_id bigint, path string, content string")
    report = Engine(spark).report_table(files)
    row = report.pairs().collect()[0]
    assert row.overlap_right == row.total_right and row.similarity == (row.overlap_left + row.overlap_right) / (row.total_left + row.total_right)
    assert report.has_fragments and report.fragments().count() >= 1


def test_templates_caps_and_replay(spark, folder, tmp_path):
    plain = Engine(spark, EngineConfig(kgram_length=10, kgrams_in_window=5, include_analysis_data=True)).report([str(folder)])
    (tmp_path / "t.txt").write_text(SHARED)
    ignoring = Engine(spark, EngineConfig(kgram_length=10, kgrams_in_window=5, template=(str(tmp_path / "t.txt"),))).report([str(folder)])
    (tmp_path / "inert.txt").write_text("zzzzqqqqwwww" * 5)
    inert = Engine(spark, EngineConfig(kgram_length=10, kgrams_in_window=5, template=(str(tmp_path / "inert.txt"),))).report([str(folder)])
    assert metrics(inert) == metrics(plain)
    best = lambda r: max(x.similarity for x in r.pairs().collect())
    assert best(ignoring) < best(plain) and ignoring.ignored_ranges().count() > 0
    capped = Engine(spark, EngineConfig(kgram_length=10, kgrams_in_window=5, max_fingerprint_count=1)).report([str(folder)])
    assert best(capped) == 0.0
    for report in (plain, ignoring):
        for row in report.pairs().collect():
            again = report.replay(row.left_id, row.right_id).collect()[0]
            assert again.asDict() == {k: v for k, v in row.asDict().items() if k != "id"}


def test_orders_and_ids(spark):
    rows = [(i, j, (i * 7 + j * 3) % 5 / 5, (i + j) % 3, i + j) for i in range(6) for j in range(i + 1, 6)]
    pairs = spark.createDataFrame(rows, "left_id int, right_id int, similarity double, longest_fragment int, total_overlap int")
    got = [(r.id, r.left_id, r.right_id) for r in ordering.sort_pairs(ordering.with_pair_id(pairs, 6), PairOrder.FILE_ID).collect()]
    assert got == [(n, *r[:2]) for n, r in enumerate(rows)]
    for order, column in ((PairOrder.SIMILARITY, 2), (PairOrder.LONGEST_FRAGMENT, 3), (PairOrder.TOTAL_OVERLAP, 4)):
        want = [r[:2] for r in sorted(rows, key=lambda r: (-r[column], r[0], r[1]))]
        assert [(r.left_id, r.right_id) for r in ordering.sort_pairs(pairs, order).collect()] == want
        ranked = ordering.ranked_pairs(pairs.repartition(5), order).collect()
        assert [(r.left_id, r.right_id) for r in sorted(ranked, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in ranked) == list(range(1, 16))
    assert ordering.pair(pairs, 4, 1).count() == 1 and ordering.pair(pairs, 2, 2).count() == 0


def test_csv_report(spark, folder, tmp_path):
    report = Engine(spark, EngineConfig(name="My réport 1", kgram_length=10, kgrams_in_window=5, compare=True, include_analysis_data=True)).report([str(folder)])
    where = sinks.write_csv(report, str(tmp_path / "out"))
    tables = {n: list(csv.DictReader(io.StringIO(t, newline=""))) for n, t in sinks.local_copy(where).items()}
    assert set(tables) == {"metadata.csv", "files.csv", "pairs.csv", "fragments.csv"}
    assert list(tables["files.csv"][0]) == ["id", "path", "content", "fingerprints", "fingerprintRegions", "ignoredIntervals"]
    assert list(tables["pairs.csv"][0]) == ["id", "leftFileId", "rightFileId", "similarity", "longestFragment", "overlapLeft", "overlapRight", "totalLeft", "totalRight", "totalOverlap"]
    assert {r["path"]: r["content"] for r in tables["files.csv"]} == TEXTS
    for r in tables["files.csv"]:
        assert len(json.loads(r["fingerprints"])) == len(json.loads(r["fingerprintRegions"])) and r["ignoredIntervals"] == "[]"
    assert len(tables["metadata.csv"]) == 13 and dict((r["property"], r["value"]) for r in tables["metadata.csv"])["maxFingerprintFileCount"] == "null"
    assert len(tables["pairs.csv"]) == 3 and len(tables["fragments.csv"]) >= 1
    with pytest.raises(FileExistsError):
        sinks.write_csv(report, where)
    assert sinks.report_dir(report.name, report.created_at).endswith("Z-My-rport-1")


def test_command_line(spark, folder, capsys, tmp_path):
    a, b = str(folder / "a.txt"), str(folder / "b.txt")
    assert cli.main(["run", a, b, "-k", "10", "-w", "5"], spark) == 0
    out = capsys.readouterr().out
    assert "a.txt - " in out and "(sim: " in out and "Total overlap: " in out and "best of times" in out
    assert cli.main(["run", str(folder), "-f", "csv", "-o", str(tmp_path / "r"), "-q"], spark) == 0
    assert cli.main(["run", str(folder), "-f", "csv", "-o", str(tmp_path / "r")], spark) == 1
    assert "is there already" in capsys.readouterr().err
    assert cli.main(["run", a, "-k", "0", "-qqq"], spark) == 1 and capsys.readouterr().err == ""
    with pytest.raises(SystemExit):
        cli.main(["run"], spark)


def test_regions_in_text():
    assert sinks.region_lines("a\néb\nc", 1, 2, 1, 3) == [(1, "a", 0, 0), (2, "éb", 1, 2), (3, "c", 0, 0)]
    assert sinks.region_lines("ab", 0, 2, 0, 1) == [(1, "ab", 2, 2)]
    text = sinks.side_by_side([(1, "x" * 100, 0, 3)], [(1, "y", 0, 1), (2, "", 0, 0)], 40)
    assert "[y]" in text and len(text.split("\n")) > 5
