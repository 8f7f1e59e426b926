"""Finding input files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import SparkSession

# File name endings by format.
FASTA_SUFFIXES = (".fa", ".fsa", ".fna", ".fasta", ".faa")
GENBANK_SUFFIXES = (".gbk", ".gb", ".genbank", ".gbf", ".gbff")
GFF_SUFFIXES = (".gtf", ".gff", ".gff3")


def suffix(path: str) -> str:
    return os.path.splitext(path)[1]


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


class Store:
    """Whether paths exist, and what folders hold: by the running session's file systems, else those of this machine.

    Paths with a scheme need a session.
    """

    def __init__(self) -> None:
        spark = SparkSession.getActiveSession()
        self.jvm, self.conf = (spark._jvm, spark._jsc.hadoopConfiguration()) if spark else (None, None)

    def status(self, path: str):
        """(file system, path) as the session knows them, or None for what isn't there."""
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.conf)
        return (fs, where) if fs.exists(where) else None

    def exists(self, path: str) -> bool:
        return bool(path) and (self.status(path) is not None if self.jvm else os.path.exists(path))

    def is_folder(self, path: str) -> bool:
        if not self.jvm:
            return os.path.isdir(path)
        met = self.status(path)
        return met is not None and met[0].getFileStatus(met[1]).isDirectory()

    def names(self, path: str) -> list[str]:
        if not self.jvm:
            return sorted(os.listdir(path))
        fs, where = self.status(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where))


def find_files(paths: Iterable[str], recurse: bool = True) -> list[str]:
    """Annotation files among paths and, in name order, in folders; without recurse, folders below the given ones are left out.

    Paths that don't exist or have another ending are left out.
    """
    store, endings = Store(), GENBANK_SUFFIXES + GFF_SUFFIXES
    found: list[str] = []
    ahead = [(str(p), True) for p in reversed(list(paths))]
    while ahead:
        path, given = ahead.pop()
        if not store.exists(path):
            continue
        if not store.is_folder(path):
            if suffix(path).lower() in endings:
                found.append(path)
        elif given or recurse:
            ahead += [(f"{path.rstrip('/')}/{name}", False) for name in reversed(store.names(path))]
    return found


def find_fasta(gff_path: str) -> str | None:
    """The sequences that belong to a GFF file: same stem, the first ending of FASTA_SUFFIXES there is."""
    store, base = Store(), os.path.splitext(gff_path)[0]
    return next((base + s for s in FASTA_SUFFIXES if store.exists(base + s)), None)


def plain_path(path: str) -> str:
    """A path without scheme and escapes, as a key: Spark gives the paths of files as URIs."""
    return unquote(re.sub(r"^[a-z]+:/+", "/", path)) if re.match(r"[a-z]+:/", path) else path


def escaped_path(path: str) -> str:
    """A literal path: characters that mean a pattern to Spark are escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
