"""Hand-made annotation files."""

from __future__ import annotations

from pathlib import Path

BASES = "ATGGCTTGTGATGAATTTGGTCATATTAAATTAATGAATCCTCAACGTTCTACTGTTTGGTATTAA"  # M A C D E F G H I K L M N P Q R S T V W Y *
PROTEIN = "MACDEFGHIKLMNPQRSTVWY"


def origin(sequence: str) -> str:
    out = []
    for i in range(0, len(sequence), 60):
        out.append(f"{i + 1:>9} " + " ".join(sequence[i + k : i + min(k + 10, 60)] for k in range(0, min(60, len(sequence) - i), 10)))
    return "\n".join(out).lower()


def feature(kind: str, location: str, **qualifiers) -> str:
    lines = [f"     {kind:<16}{location}"]
    for k, values in qualifiers.items():
        for v in values if isinstance(values, list) else [values]:
            lines.append(" " * 21 + f'/{k}="{v}"')
    return "\n".join(lines)


def genbank(name: str, sequence: str | None, features: list[str], topology: str = "linear", version: str | None = None, length: int | None = None) -> str:
    n = length if length is not None else len(sequence or "")
    parts = [f"LOCUS       {name}  {n} bp    DNA     {topology} UNK 01-JAN-2020", "DEFINITION  made by hand.", f"ACCESSION   {name}", f"VERSION     {version or name + '.1'}", "FEATURES             Location/Qualifiers"]
    parts += features
    if sequence:
        parts += ["ORIGIN", origin(sequence)]
    return "\n".join([*parts, "//", ""])


def write(folder: Path, name: str, text: str) -> str:
    path = folder / name
    path.write_text(text)
    return str(path)


def clusters(folder: Path) -> list[str]:
    """Three small clusters with related proteins."""
    a = genbank("A", BASES * 3, [feature("gene", "1..66", locus_tag="a1"), feature("CDS", "1..66", protein_id="A1", translation=PROTEIN * 3), feature("CDS", "67..132", protein_id="A2", translation="MKVLWAALLVTFLAG" * 3)])
    b = genbank("B", BASES * 2, [feature("CDS", "1..66", protein_id="B1", translation=PROTEIN * 2 + "MACDEFGHIKLMNPQRSTVWW"), feature("CDS", "67..132", protein_id="B2", translation="MKVLWAALLVTFLAG" * 2 + "MKVIWAALLVTFLAG")])
    c = genbank("C", BASES * 2, [feature("CDS", "1..66", protein_id="C1", translation="WWWWHHHHPPPPGGGGNNNN" * 2)])
    return [write(folder, f"{n}.gbk", t) for n, t in (("alpha", a), ("beta", b), ("gamma", c))]
