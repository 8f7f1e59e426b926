"""Column functions: labels, maps, nucleotide sequences, similarity of aligned strings. JVM side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Qualifiers that may name a gene, in order of preference (fixed value).
LABEL_KEYS = ("protein_id", "locus_tag", "id", "ID", "gene", "label", "name")
#: Amino acids whose exchange counts as similar (fixed value).
SIMILAR = ("GAVLI", "FYW", "CM", "ST", "KRH", "DENQ", "P")
#: The standard genetic code, codons in the order of bases TCAG (fixed value).
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASES = "TCAG"
#: IUPAC nucleotide codes and their complements (fixed values).
NUCLEOTIDES = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
COMPLEMENTS = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"


def first_of(names: Column, keys: tuple[str, ...] = LABEL_KEYS) -> Column:
    """Value of the first key that a map has."""
    return F.coalesce(*(F.element_at(names, k) for k in keys))


def label(names: Column, default: Column, keys: tuple[str, ...] = LABEL_KEYS) -> Column:
    """A gene's label; an empty one gives the default too."""
    return F.coalesce(F.nullif(first_of(names, keys), F.lit("")), default)


def submap(names: Column, keys: list[str]) -> Column:
    """The entries with one of the keys, whatever their case."""
    wanted = F.array(*(F.lit(k.lower()) for k in keys)) if keys else F.array().cast("array<string>")
    return F.map_filter(names, lambda k, _: F.array_contains(wanted, F.lower(k)))


def first_values(qualifiers: Column) -> Column:
    """array<struct<key,value>> as a map; a repeated key keeps its first value."""
    keys = F.array_distinct(F.transform(qualifiers, lambda q: q["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.get(F.filter(qualifiers, lambda q: q["key"] == k), F.lit(0))["value"].alias("value"))))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, NUCLEOTIDES, COMPLEMENTS))


def extract(seq: Column, exons: Column) -> Column:
    """The parts' bases in their given order, those of the minus strand as reverse complements; parts are 0-based, end exclusive."""

    def part(e: Column) -> Column:
        bases = F.substring(seq, e["start"] + 1, e["end"] - e["start"])
        return F.when(e["strand"] == -1, reverse_complement(bases)).otherwise(bases)

    return F.array_join(F.transform(exons, part), "")


def translate_codons(seq: Column) -> Column:
    """Amino acids of the whole codons by the standard code; stops are *, codons with other letters X."""
    codons = F.regexp_extract_all(F.translate(F.upper(seq), "U", "T"), F.lit("(?s)..."), F.lit(0))  # cut once, so that no codon looks for its place in the text

    def amino(codon: Column) -> Column:
        a, b, c = (F.instr(F.lit(BASES), F.substring(codon, k, 1)) for k in (1, 2, 3))
        at = (a - 1) * 16 + (b - 1) * 4 + c
        return F.when((a > 0) & (b > 0) & (c > 0), F.substring(F.lit(CODE), at, F.lit(1))).otherwise(F.lit("X"))

    return F.coalesce(F.array_join(F.transform(codons, amino), ""), F.lit(""))


def _letter_pairs(a: Column, b: Column) -> Column:
    return F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def aligned_identity(a: Column, b: Column) -> Column:
    """(identity, similarity) of two aligned strings of equal length; columns of two gaps don't count."""
    gap = lambda x: x.isin("-", ".")
    columns = F.filter(_letter_pairs(a, b), lambda p: ~(gap(p["x"]) & gap(p["y"])))
    same = F.size(F.filter(columns, lambda p: (p["x"] == p["y"]) & ~gap(p["x"])))
    class_of = F.create_map(*(F.lit(v) for k, s in enumerate(SIMILAR) for c in s for v in (c, k)))
    alike = F.size(F.filter(columns, lambda p: (p["x"] != p["y"]) & F.coalesce(class_of[p["x"]] == class_of[p["y"]], F.lit(False))))
    return F.struct((same / F.size(columns)).alias("identity"), ((same + alike) / F.size(columns)).alias("similarity"))


def stable_id(*parts: Column) -> Column:
    """A deterministic id: unlike uuid() it survives recomputation and retries."""
    return F.sha2(F.concat_ws("~", *(p.cast("string") for p in parts)), 256)


def fixed_decimals(value: Column, decimals: int) -> Column:
    """value in fixed notation, half to even on the exact binary value, for values below 1,000."""
    return F.format_number(value, decimals)


def shifted(position: Column, shift: int | Column, length: int | Column) -> Column:
    """A position on a circle of `length` whose origin moves to `shift`."""
    return F.pmod(position - shift, F.lit(length) if isinstance(length, int) else length)
