"""Operator 2: license scans, then nearest-ancestor directory inheritance by path joins.

A text is scanned whole: the file, every paragraph, line and sentence are compared with license templates
(titles, headers, notices and tags, by version) by sparse TF-IDF cosine.  The inverse document frequencies
come from all texts of the table, for the templates' words only (a fixed, small vocabulary); other words
weigh like the rarest.  A passage can reach THRESHOLD for a template only if it holds one of the template's
anchor words - its heaviest words, without which the rest is too light - so only templates with an anchor in
the passage are tried, and no result changes.  A template that names the license, a version or a variant
(``mit``, ``2.1``, ``lesser``, ``nc``) counts only where the passage names it too, so that no text gets the license of another
version; a family without a version is found only where no version is.

A file named like LICENSE or COPYING licenses its directory.  Directories, not files, are joined with
their ancestors: each directory takes the license of the nearest one, and files then join their directory.
A directory with any number of files is one row until the last join, which can split a large directory.

A copyright notice is also tried without its years and holder.  Licensed texts often carry such a notice,
so reserved rights count only where no license reaches the threshold.

Defined cases: null and empty texts have no license of their own; of equal scores the first name in the
alphabet wins; several license files in one directory: the best score, then the smallest path; a null path
is outside every directory; repeated rows are judged alike; very long texts are scanned whole; an empty
table gives an empty table; other columns pass through, and one named like a column that is added is an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import fresh, materialize, refuse_clash, small_batches, table, worker_state

THRESHOLD = 0.62
BATCH_ROWS = 256
LICENSE_FILES = ("license", "licence", "copying", "unlicense", "notice")

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Titles and headers as their publishers word them (fixed values), and common short notices.
_WORDINGS = (
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("Apache-2.0", "apache license version 2.0 january 2004 http www apache org licenses"),
    ("Apache-1.1", "the apache software license version 1.1"),
    ("GPL-1.0", "gnu general public license version 1 february 1989"),
    ("GPL-2.0", "gnu general public license version 2 june 1991"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("LGPL-2.0", "gnu library general public license version 2 june 1991"),
    ("LGPL-2.1", "gnu lesser general public license version 2.1 february 1999"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("GFDL-1.1", "gnu free documentation license version 1.1 march 2000"),
    ("GFDL-1.2", "gnu free documentation license version 1.2 november 2002"),
    ("GFDL-1.3", "gnu free documentation license version 1.3 3 november 2008"),
    ("MPL-1.0", "mozilla public license version 1.0"),
    ("MPL-1.1", "mozilla public license version 1.1"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("EPL-1.0", "eclipse public license v 1.0"),
    ("EPL-2.0", "eclipse public license v 2.0"),
    ("EUPL-1.2", "european union public licence v 1.2"),
    ("BSL-1.0", "boost software license version 1.0"),
    ("Artistic-1.0", "the artistic license preamble"),
    ("Artistic-1.0", "the artistic license"),
    ("Artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("Artistic-2.0", "the artistic license 2.0"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "licensed under the bsd 2 clause license"),
    ("BSD-3-Clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license"),
    ("ISC", "licensed under the isc license"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("Zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("CC0-1.0", "cc0 1.0 universal"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0 universal"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("WTFPL", "do what the fuck you want to public license"),
    ("GPL", "licensed under the gnu general public license"),
    ("LGPL", "licensed under the gnu lesser general public license"),
    ("AGPL", "licensed under the gnu affero general public license"),
    ("Proprietary", "copyright all rights reserved no part may be reproduced without written permission"),
    ("Proprietary", "copyright all rights reserved"),
    ("Proprietary", "all rights reserved"),
)

#: Reserves rights and grants none.
RESERVED = "Proprietary"
#: Names that say less than another that the same text may have.
GENERIC = frozenset(("GPL", "LGPL", "AGPL", "BSD-2-Clause"))


def _templates() -> tuple[tuple[str, str], ...]:
    """The wordings, those that follow a rule by version or variant, and the tags of every name."""
    out = list(_WORDINGS)
    kinds = (("GPL", "gnu general", ("1", "2", "3")), ("LGPL", "gnu lesser general", ("2.1", "3")), ("LGPL", "gnu library general", ("2",)), ("AGPL", "gnu affero general", ("3",)))
    for name, family, versions in kinds:
        for v in versions:
            full = f"{name}-{v if '.' in v else v + '.0'}"
            for said in dict.fromkeys((v, full.rpartition("-")[2])):
                out.append((full, f"this work is licensed under the {family} public license version {said}"))
                out.append((full, f"this program is free software you can redistribute it and or modify it under the terms of the {family} public license as published by the free software foundation either version {said} of the license or at your option any later version"))
    longer = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    for variant in ("", "sa", "nc", "nd", "nc sa", "nc nd"):
        for v in ("2.0", "2.5", "3.0", "4.0"):
            name = "-".join(("CC-BY", *variant.upper().split(), v))
            out.append((name, f"licensed under cc by {variant} {v}"))
            kind = "unported" if v == "3.0" else "international" if v == "4.0" else "generic"
            out.append((name, f"licensed under a creative commons attribution {' '.join(longer[x] for x in variant.split())} {v} {kind} license"))
    names = dict.fromkeys(name for name, _ in out if name != RESERVED)
    for name in names:
        tag = name.lower().replace("-", " ")
        out.append((name, f"spdx license identifier {tag}"))
        if name.startswith(("GPL-", "LGPL-", "AGPL-", "GFDL-")):
            out += [(name, f"spdx license identifier {tag} {more}") for more in ("only", "or later")]
    return tuple((name, " ".join(words(text))) for name, text in out)


TEMPLATES = _templates()
#: Words that tell versions and variants of one license apart.
_VARIANTS = frozenset("1 2 3 1.0 1.1 1.2 1.3 2.0 2.1 2.5 3.0 4.0 nc sa nd noncommercial sharealike noderivatives lesser library affero 0".split())
#: A notice with its years and holder, which are words of no template, on one line and of any length.  Each attempt
#: ends at the next sign of its own kind, so that a line is read a few times at most.
_NOTICE = re.compile(r"\bcopyright\b(?:(?!\bcopyright\b)[^\n])*?\ball\s+rights\s+reserved\b|(?:\(c\)|\u00a9)(?:(?!\(c\)|\u00a9)[^\n])*?\ball\s+rights\s+reserved\b")
#: Paragraphs, lines, sentences, and sentences of one line.
_CUTS = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"(?<=[.!?:])\s"), re.compile(r"\n|(?<=[.!?:])\s"))
#: "v2.0" names version 2.0.
_VERSION = re.compile(r"(?<![a-z0-9])v(?=[0-9])")
VOCABULARY = sorted({w for _, t in TEMPLATES for w in words(t)})


class Scanner:
    """Templates as unit vectors under given document frequencies."""

    def __init__(self, n_docs: int, frequency: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.rarest = math.log(1 + n_docs) + 1
        self.idf = {w: math.log((1 + n_docs) / (1 + min(n_docs, frequency.get(w, 0)))) + 1 for w in VOCABULARY}
        #: name, words that must occur, unit vector
        self.vectors: list[tuple[str, frozenset[str], dict[str, float]]] = []
        #: The templates that each anchor word leads to.
        self.anchors: dict[str, list[int]] = {}
        for name, text in templates:
            v = {w: n * self.idf[w] for w, n in Counter(words(text)).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            rest = 1.0
            for w in sorted(v, key=lambda w: (-v[w], w)):
                if math.sqrt(max(0.0, rest)) < threshold * 0.999:
                    break
                self.anchors.setdefault(w, []).append(len(self.vectors))
                rest -= v[w] ** 2
            self.vectors.append((name, (_VARIANTS | set(words(name))).intersection(v), v))
        self.anchor_words = frozenset(self.anchors)

    def scores(self, passage: str) -> list[tuple[str, float]]:
        """(name, cosine) of each template that the passage reaches the threshold for."""
        counts = Counter(words(_VERSION.sub("", passage)))
        met = self.anchor_words.intersection(counts)
        if not met:
            return []
        v = {w: n * self.idf.get(w, self.rarest) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out = []
        for i in sorted({i for w in met for i in self.anchors[w]}):
            name, must, t = self.vectors[i]
            if must <= v.keys():
                cosine = sum(x * v.get(w, 0.0) for w, x in t.items()) / norm
                if cosine >= self.threshold:
                    out.append((name, cosine))
        return out

    def scan(self, text: str | None) -> tuple[str | None, float]:
        """(license, cosine) of the best passage that reaches the threshold."""
        if not text:
            return None, 0.0
        low = text.lower()
        if self.anchor_words.isdisjoint(words(low)):
            return None, 0.0
        passages = dict.fromkeys((low, *(p for cut in _CUTS for p in cut.split(low))))
        if _NOTICE.search(low):
            passages["copyright all rights reserved"] = None
        found = [s for p in passages for s in self.scores(p)]
        if not found:
            return None, 0.0
        _, _, value, name = min((n == RESERVED, n in GENERIC, -round(s, 9), n) for n, s in found)
        return name, -value


def frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Rows with a text, and for each word of the vocabulary the number of texts that hold it."""
    vocabulary = VOCABULARY

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worker_state("license_scan")
        wanted, seen, rows = set(vocabulary), Counter(), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    rows += 1
                    seen.update(wanted.intersection(words(value)))
        yield pa.RecordBatch.from_pydict({"word": [*seen, ""], "n": [*seen.values(), rows]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    # One row for each word of the fixed vocabulary: a few hundred at most.
    found = {r["word"]: r["n"] for r in docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop("", 0), found


def scan(docs: DataFrame, text: str = "text", out: str = "own_license", score: str = "own_score") -> DataFrame:
    """``docs`` without the text, with each row's own license and its cosine."""
    refuse_clash(docs, {out, score}, {text})
    small_batches(docs.sparkSession)
    n, seen = frequencies(docs, text)
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType(), False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worker_state("license_scan")
        own = Scanner(n, seen)
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            found = [own.scan(v) for v in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*[f.name for f in kept], out, score])

    return docs.mapInArrow(run, schema)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherit(files: DataFrame, path: str = "path", own: str = "own_license", score: str = "own_score") -> DataFrame:
    """Add ``license`` and ``license_dir``: a file's own license, else its nearest ancestor's.  ``files`` is
    written to a scratch table first, since three steps read it and a scan is dear."""
    refuse_clash(files, {"license", "license_dir"})
    here, origin, given = (fresh(c, files.columns) for c in ("__dir", "__from", "__license"))
    base = F.lower(F.regexp_extract(F.col(path), r"([^/]*)$", 1))
    is_license = F.regexp_extract(base, r"^([a-z]+)", 1).isin(*LICENSE_FILES)
    files = materialize(files.withColumn(here, directory(F.col(path))), "license-scan")
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(path).alias("p"), F.col(own).alias("l")))
    licensed = files.filter(is_license & F.col(own).isNotNull()).groupBy(F.col(here).alias("a")).agg(best.alias("best")).select("a", F.col("best.l").alias("l"))
    dirs = files.filter(F.col(here).isNotNull()).select(F.col(here).alias("d")).distinct()
    parts = F.split("d", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    chains = dirs.select("d", F.posexplode(F.when(F.col("d") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), ancestors))).alias("depth", "a"))
    nearest = chains.join(licensed, "a").groupBy("d").agg(F.max(F.struct("depth", "a", "l")).alias("near")).select(F.col("d").alias(f"{here}_d"), F.col("near.a").alias(origin), F.col("near.l").alias(given))
    joined = files.join(nearest, F.col(here) == F.col(f"{here}_d"), "left")
    return joined.select(*[F.col(c) for c in files.columns if c != here], F.coalesce(own, given).alias("license"), F.when(F.col(own).isNull(), F.col(origin)).alias("license_dir"))


def document_path(doc_id: Column, source: Column) -> Column:
    """The documents table has no paths: a tree by source and id, in which every 64th file is a LICENSE."""
    deep = F.concat_ws("/", F.coalesce(source, F.lit("none")), F.concat(F.lit("d"), F.floor(doc_id / 4096).cast("string")), F.concat(F.lit("p"), F.floor(doc_id / 256).cast("string")))
    above = F.when(doc_id % 256 == 0, F.regexp_replace(deep, "/[^/]*$", "")).otherwise(deep)
    return F.concat(above, F.when(doc_id % 64 == 0, F.lit("/LICENSE.")).otherwise(F.lit("/file.")), doc_id.cast("string"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", document_path(F.col("doc_id"), F.col("source")).alias("path"), "text")
    return inherit(scan(files)).select("doc_id", "path", "own_license", "own_score", "license", "license_dir")
