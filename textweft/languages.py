"""Programming languages by name and file extension."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAR = "Char"


class UnknownLanguage(ValueError):
    """No language has this name, or none can be told from the files."""


def _table(text: str) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    out = {}
    for line in text.strip().splitlines():
        names, extensions = line.split(":")
        name, *aliases = names.split("/")
        out[name.strip()] = (tuple(a.strip() for a in aliases), tuple(extensions.split()))
    return out


#: name -> (aliases, extensions)
LANGUAGES = _table(
    """
Bash/shell/sh: sh bash
C: c h
Char: txt md
Cpp/c++: cpp hpp cc cp cxx c++ h hh hxx h++
CSharp/c#: cs csx
Dart: dart
Elixir: ex exs
Elm: elm
Go/golang: go
Groovy: groovy gvy gy gsh
Haskell: hs lhs
Java: java
JavaScript/js: js
Julia: jl
Kotlin: kt kts
Lua: lua
Modelica: mo
OCaml: ml
Perl: pl pm t
PHP: php php3 php4 php5 php7 phps phpt phtml
Python/py: py py3
R: r
Ruby: rb rbw
Rust: rs
Scala: scala sc
SQL: sql
Swift: swift
TypeScript/ts: ts
TSX: tsx
Verilog: v vh
"""
)


def from_name(name: str) -> str:
    """The language that has a name or alias, whatever its case."""
    wanted = name.lower()
    for language, (aliases, _) in LANGUAGES.items():
        if wanted == language.lower() or wanted in aliases:
            return language
    raise UnknownLanguage(f"there is no language called {name!r}")


def extension(path: str) -> str:
    return PurePosixPath(path).suffix[1:].lower()


def from_path(path: str) -> list[str]:
    """All languages that use the extension of a path."""
    end = extension(path)
    return [n for n, (_, extensions) in LANGUAGES.items() if end and end in extensions]


def matches(language: str, path: str) -> bool:
    return language in from_path(path)


def extension_column(path) -> F.Column:
    """``extension`` as a Spark expression; empty for names without one and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def language_table(spark: SparkSession) -> DataFrame:
    """``(language, extension)``, some forty rows."""
    return spark.createDataFrame([(n, e) for n, (_, extensions) in LANGUAGES.items() for e in extensions], "language string, extension string")


def language_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """``(language, files)``: how many paths may be of each language; a path may count for several."""
    named = files.select(extension_column(F.col(path)).alias("extension"))
    return named.join(F.broadcast(language_table(files.sparkSession)), "extension").groupBy("language").agg(F.count("*").alias("files"))


def detect(files: DataFrame, path: str = "path") -> str:
    """The language that most paths may be of. Plain text counts only where no language occurs; a tie is an error."""
    counts = sorted(((r["files"], r["language"]) for r in language_counts(files, path).collect()), key=lambda x: (-x[0], x[1]))  # one row a language
    coded = [c for c in counts if c[1] != CHAR]
    ranked = coded or counts
    if not ranked:
        raise UnknownLanguage("the language can't be told from the files' extensions; name one")
    if len(ranked) > 1 and ranked[0][0] == ranked[1][0]:
        raise UnknownLanguage(f"{ranked[0][1]} and {ranked[1][1]} fit as many files; name one")
    return ranked[0][1]
