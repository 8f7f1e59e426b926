"""GenBank flat files as record rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..schemas import RECORDS
from .discovery import escaped_path, plain_path, stem

QUALIFIER = re.compile(r"/([A-Za-z0-9_.-]+)(?:=(.*))?$", re.S)


def parse_location(text: str, strand: int = 1) -> list[dict]:
    """Parts of a feature location in biological order, 0-based and end exclusive. < and > are dropped."""
    text = text.strip()
    inner = re.fullmatch(r"(complement|join|order)\((.*)\)", text, re.S)
    if inner is None:
        numbers = re.fullmatch(r"(?:[\w.]+:)?[<>]?(\d+)(?:(?:\.\.|\.|\^)[<>]?(\d+))?", text)
        if numbers is None:
            raise ValueError(f"not a location: {text!r}")
        a, b = int(numbers[1]), int(numbers[2] or numbers[1])
        return [{"start": a - 1, "end": b, "strand": strand}]
    if inner[1] == "complement":
        return parse_location(inner[2], -strand)[::-1]
    parts, depth, begin = [], 0, 0
    for i, c in enumerate(inner[2] + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts += parse_location(inner[2][begin:i], strand)
            begin = i + 1
    # complement(join(a,b)) reads b before a: the outer complement turns the list round
    return parts


def unquoted(value: str, key: str) -> str:
    """A qualifier's text: lines are joined by a space, those of translations by nothing."""
    lines = [x.strip() for x in value.split("\n")]
    text = ("" if key == "translation" else " ").join(lines)
    if len(text) > 1 and text[0] == text[-1] == '"':
        text = text[1:-1]
    return text.replace('""', '"')


def parse_features(lines: list[str]) -> list[dict]:
    """Features of a table; keys stand from column 6, their lines from column 22 on."""
    blocks: list[tuple[str, list[str]]] = []
    for line in lines:
        if line[5:6].strip():
            kind = line[5:21].strip().split()[0]
            blocks.append((kind, [line[21:]]))
        elif blocks and line.strip():
            blocks[-1][1].append(line[21:])
    out = []
    for kind, text in blocks:
        entries, quoted = [text[0]], False
        for line in text[1:]:
            if line.startswith("/") and not quoted:
                entries.append(line)
            else:
                entries[-1] += "\n" + line
            if entries[-1].startswith("/"):
                quoted = entries[-1].count('"') % 2 == 1
        qualifiers = []
        for e in entries[1:]:
            if m := QUALIFIER.match(e):
                qualifiers.append({"key": m[1], "value": unquoted(m[2] or "", m[1])})
        out.append({"feature_ord": len(out), "type": kind, "exons": parse_location("".join(entries[0].split())), "qualifiers": qualifiers})
    return out


def parse_records(text: str) -> Iterator[dict]:
    """The records of a file; a record without sequence has a null one."""
    for block in re.split(r"^//[ \t]*$", text.replace("\r\n", "\n"), flags=re.M):
        lines = block.strip("\n").split("\n")
        if not lines or not any(x.startswith("LOCUS") for x in lines):
            continue
        sections: dict[str, list[str]] = {}
        current: list[str] = []
        for line in lines:
            if line[:1].strip():
                current = sections.setdefault(line.split()[0], [])
                current.append(line)
            else:
                current.append(line)
        locus = sections["LOCUS"][0].split()
        name = locus[1]
        length = next((int(a) for a, b in zip(locus, locus[1:]) if b in ("bp", "aa") and a.isdigit()), None)
        accession = sections.get("ACCESSION", [""])[0].split()[1:2]
        version = sections.get("VERSION", [""])[0].split()[1:2]
        origin = "".join(re.sub(r"[\d\s]", "", x) for x in sections.get("ORIGIN", [""])[1:]).upper()
        yield {
            "record_id": (version or accession or [name])[0], "record_name": name,
            "topology": "circular" if "circular" in locus else "linear",
            "length": length if length is not None else len(origin), "sequence": origin or None,
            "features": parse_features(sections.get("FEATURES", [""])[1:]),
        }


def read_genbank(spark: SparkSession, paths: list[str], ordinals: list[int] | None = None) -> DataFrame:
    """RECORDS rows of the files. Each file is one task's work and is read by Spark, whatever the store.

    ordinals: each file's cluster_ord; else its place in paths.
    """
    from ..plans.arrow import arrow_schema

    place: dict[str, list[tuple[int, str]]] = {}  # a file may be given more than once
    for p, o in zip(paths, ordinals or range(len(paths))):
        place.setdefault(plain_path(p), []).append((o, p))
    schema = StructType.fromDDL(RECORDS)
    arrow = arrow_schema(schema)

    def run(batches):
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, r in enumerate(parse_records(data.decode("utf-8", "replace"))):
                    for order, given in place[plain_path(path)]:
                        rows.append({"cluster_ord": order, "cluster_name": stem(given), "source_path": given, "record_ord": k, **r})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").load([escaped_path(p) for p in dict.fromkeys(paths)]).select("path", "content").mapInArrow(run, schema)
