import pytest
from pyspark.sql import functions as F

from geneloom.operators.annotation import tables_of_gff, tables_of_records
from geneloom.session import from_rows, parse_files
from geneloom.sources import discovery, side_inputs
from geneloom.sources.fasta import read_fasta
from geneloom.sources.genbank import parse_location, parse_records, read_genbank
from geneloom.sources.gff3 import read_gff
from tests.fixtures import BASES, PROTEIN, feature, genbank, write


def spans(text):
    return [(e["start"], e["end"], e["strand"]) for e in parse_location(text)]


def test_locations():
    assert spans("3..9") == [(2, 9, 1)]
    assert spans("<3..>9") == [(2, 9, 1)]
    assert spans("7") == [(6, 7, 1)]
    assert spans("join(1..5,8..10)") == [(0, 5, 1), (7, 10, 1)]
    assert spans("complement(join(1..5,8..10))") == [(7, 10, -1), (0, 5, -1)]
    assert spans("join(complement(8..10),complement(1..5))") == [(7, 10, -1), (0, 5, -1)]
    assert spans("order(J00194.1:1..2,complement(4..5))") == [(0, 2, 1), (3, 5, -1)]
    with pytest.raises(ValueError):
        parse_location("somewhere")


def test_records_of_a_file():
    text = genbank("R1", BASES, [feature("source", "1..66"), feature("CDS", "join(1..20,\n                     30..66)", note="two\n                     lines with / and \"\"quotes\"\"", translation="MAC\n                     DEF", db_xref=["x:1", "y:2"])]) + genbank("R2", None, [], length=500)
    one, two = parse_records(text.replace("\n", "\r\n"))
    assert (one["record_id"], one["record_name"], one["length"], one["sequence"]) == ("R1.1", "R1", 66, BASES)
    (cds,) = [f for f in one["features"] if f["type"] == "CDS"]
    held = [(q["key"], q["value"]) for q in cds["qualifiers"]]
    assert held == [("note", 'two lines with / and "quotes"'), ("translation", "MACDEF"), ("db_xref", "x:1"), ("db_xref", "y:2")]
    assert [(e["start"], e["end"]) for e in cds["exons"]] == [(0, 20), (29, 66)]
    assert two["sequence"] is None and two["length"] == 500 and two["features"] == []


def genes_of(tables, *columns):
    rows = tables["genes"].join(tables["loci"].select("locus_id", "locus_ord"), "locus_id").orderBy("cluster_id", "locus_ord", "gene_ord").collect()
    return [tuple(r[c] for c in columns) for r in rows]


def test_genbank_tables(spark, tmp_path):
    features = [
        feature("CDS", "67..132", protein_id="P2"), feature("gene", "1..200", locus_tag="g"), feature("CDS", "1..66", locus_tag="T1", protein_id="P1", translation="MXX"),
        feature("CDS", "complement(join(70..80,90..100))", gene="minus"), feature("CDS", "150..210", note="no parent"), feature("gene", "140..170"), feature("CDS", "150..160", label="first parent wins"),
    ]
    path = write(tmp_path, "my cluster+ [1].gbk", genbank("R1", BASES * 4, features) + genbank("R2", None, [feature("CDS", "1..9", protein_id="Q")], length=30))
    tables = tables_of_records(read_genbank(spark, [path]))
    (cluster,) = tables["clusters"].collect()
    assert (cluster["name"], cluster["cluster_ord"], cluster["source_path"]) == ("my cluster+ [1]", 0, path)
    assert [(r["locus_ord"], r["name"], r["start"], r["end"]) for r in tables["loci"].orderBy("locus_ord").collect()] == [(0, "R1", 0, 264), (1, "R2", 0, 30)]
    found = genes_of(tables, "label", "start", "end", "strand", "translation")
    assert found[0] == ("P2", 66, 200, 1, PROTEIN + "*")  # the parent's start of 0 counts as none
    assert found[1] == ("P1", 0, 200, 1, "MXX")
    assert found[2][:4] == ("minus", 69, 200, -1)
    assert found[3][1:4] == (149, 210, 1) and len(found[3][0]) == 64  # without a name the id is the label
    assert found[4][:3] == ("first parent wins", 149, 200)
    assert found[5][:3] == ("Q", 0, 9) and found[5][4] == ""  # no sequence, no translation
    minus = next(s for label, s in genes_of(tables, "label", "sequence") if label == "minus")
    whole = (BASES * 4).translate(str.maketrans("ACGT", "TGCA"))
    assert minus == whole[89:100][::-1] + whole[69:80][::-1]
    names = dict(genes_of(tables, "label", "names"))
    assert names["P1"] == {"locus_tag": "T1", "protein_id": "P1"}


def test_ranges_and_separate_clusters(spark, tmp_path):
    path = write(tmp_path, "f.gb", genbank("R1", BASES * 3, [feature("CDS", "1..66", protein_id="A"), feature("CDS", "67..132", protein_id="B")]) + genbank("R2", BASES, [feature("CDS", "1..66", protein_id="C")]))
    tables = tables_of_records(read_genbank(spark, [path]), {"R1.1": (60, 140)})
    assert [g for (g,) in genes_of(tables, "label")] == ["B", "C"]
    assert dict(genes_of(tables, "label", "translation"))["B"] == PROTEIN + "*"
    assert [(r["start"], r["end"]) for r in tables["loci"].orderBy("locus_ord").collect()] == [(60, 140), (0, 66)]
    apart = tables_of_records(read_genbank(spark, [path]), as_separate_clusters=True)
    assert [(r["name"], r["cluster_ord"]) for r in apart["clusters"].orderBy("cluster_ord").collect()] == [("fR1.1", 0), ("fR2.1", 1)]


def test_circular_records_start_at_the_gene_over_the_origin(spark, tmp_path):
    turned = BASES[40:] + "CC" + BASES[:40]
    features = [feature("gene", "join(29..68,1..26)"), feature("CDS", "join(29..68,1..26)", protein_id="over"), feature("CDS", "3..8", protein_id="in")]
    path = write(tmp_path, "ring.gbk", genbank("R", turned, features, "circular"))
    tables = tables_of_records(read_genbank(spark, [path]))
    found = {r[0]: r[1:] for r in genes_of(tables, "label", "start", "end", "translation", "sequence")}
    assert found["over"] == (0, 66, PROTEIN + "*", BASES)
    assert found["in"][:2] == (42, 66)  # the gene contains it too
    left = tables_of_records(read_genbank(spark, [path]), set_origin=False)
    assert {r[0]: r[1:] for r in genes_of(left, "label", "start", "end")}["in"] == (2, 68)
    spliced = genbank("S", BASES, [feature("CDS", "complement(join(1..20,30..66))", protein_id="minus")], "circular")
    stays = tables_of_records(read_genbank(spark, [write(tmp_path, "s.gbk", spliced)]))
    assert genes_of(stays, "start", "end") == [(0, 66)]


GFF = """##gff-version 3
##sequence-region ctg2 101 400
ctg1\t.\tgene\t1\t70\t.\t+\t.\tID=g1;Name=first
ctg1\t.\tmRNA\t1\t70\t.\t+\t.\tID=m1;Parent=g1
ctg1\t.\tCDS\t1\t30\t.\t+\t0\tID=c1;Parent=m1;product=a%2Cb+c
ctg1\t.\tCDS\t31\t66\t.\t+\t0\tID=c1;Parent=m1
ctg1\t.\tCDS\t70\t80\t.\t-\t0\tID=c2
ctg1\t.\tCDS\t90\t100\t.\t-\t0\tID=c2
ctg1\t.\tCDS\t110\t115\t.\t+\t0\tID=x
ctg1\t.\tCDS\t112\t118\t.\t+\t0\tID=y
ctg1\t.\tCDS\t120\t126\t.\t+\t0\tID=x
ctg1\t.\tgene\t100\t300\t.\t+\t.\tID=g9
ctg1\t.\tCDS\t130\t140\t.\t+\t0\tID=over;Parent=g9
ctg2\t.\tCDS\t101\t106\t.\t+\t0\tID=d1
ctg2\t.\tCDS\t390\t402\t.\t+\t0\tID=outside
##FASTA
>ignored
ACGT
"""


def test_gff(spark, tmp_path):
    path = write(tmp_path, "g.gff3", GFF)
    with pytest.raises(FileNotFoundError):
        read_gff(spark, [path])
    write(tmp_path, "g.fa", f">ctg1 some words\n{BASES * 3}\n{BASES[:2]}\n\n>ctg2\n{BASES[:30]}\n{BASES[30:]}\n")
    tables = tables_of_gff(*read_gff(spark, [path]))
    assert [(r["name"], r["start"], r["end"]) for r in tables["loci"].orderBy("locus_ord").collect()] == [("ctg1", 0, 200), ("ctg2", 100, 400)]
    found = {r[0]: r[1:] for r in genes_of(tables, "label", "start", "end", "strand", "sequence")}
    assert found["c1"] == (1, 70, 1, BASES)  # 1-based from the parent
    whole = (BASES * 3).translate(str.maketrans("ACGT", "TGCA"))
    assert found["c2"] == (69, 100, -1, whole[89:100][::-1] + whole[69:80][::-1])  # 0-based without one
    assert [g for (g,) in genes_of(tables, "label")] == ["c1", "c2", "x", "y", "x", "d1"]  # interleaved ids don't merge; over and outside are left out
    assert found["d1"] == (100, 106, 1, BASES[:6])
    names = dict(genes_of(tables, "label", "names"))
    assert names["c1"]["product"] == "a,b+c"
    ranged = tables_of_gff(*read_gff(spark, [path], ranges={"ctg1": (60, 120)}))
    assert [(r[0], r[1], r[3]) for r in genes_of(ranged, "label", "start", "end", "sequence") if r[0] == "y"] == [("y", 111, (BASES * 3)[111:118])]


def test_rows_without_id_or_bad_regions_are_errors(spark, tmp_path):
    write(tmp_path, "b.fa", f">c\n{BASES}\n")
    path = write(tmp_path, "b.gff", "c\t.\tCDS\t1\t9\t.\t+\t0\tParent=g\n")
    with pytest.raises(Exception, match="no ID"):
        tables_of_gff(*read_gff(spark, [path]))["genes"].collect()
    path = write(tmp_path, "b.gff3", "##sequence-region c  1 9\nc\t.\tCDS\t1\t9\t.\t+\t0\tID=g\n")
    with pytest.raises(Exception, match="sequence-region"):
        tables_of_gff(*read_gff(spark, [path]))["genes"].collect()


def test_fasta(spark, tmp_path):
    path = write(tmp_path, "f.fa", ">a b c\r\nAC GT\r\n\r\nTT\n>d\n>e\nGG")
    assert [(r["ord"], r["id"], r["sequence"]) for r in read_fasta(spark, [path]).orderBy("ord").collect()] == [(0, "a", "ACGTTT"), (1, "d", ""), (2, "e", "GG")]


def test_find_files(tmp_path):
    deep = tmp_path / "x" / "y"
    deep.mkdir(parents=True)
    a, b, c = write(tmp_path, "b.GBK", ""), write(tmp_path / "x", "a.gff", ""), write(deep, "z.gb", "")
    write(tmp_path, "n.txt", "")
    assert discovery.find_files([str(tmp_path)]) == [a, b, c]
    assert discovery.find_files([str(tmp_path)], recurse=False) == [a]
    assert discovery.find_files([c, "missing.gbk", a]) == [c, a]


def test_parse_files_keeps_the_order_of_mixed_kinds(spark, tmp_path):
    one = write(tmp_path, "one.gff", "c\t.\tCDS\t1\t66\t.\t+\t0\tID=p\n")
    write(tmp_path, "one.fasta", f">c\n{BASES}\n")
    two = write(tmp_path, "two.gbk", genbank("R", BASES, [feature("CDS", "1..66", protein_id="q")]))
    tables = parse_files(spark, [two, one, ])
    assert [r["name"] for r in tables["clusters"].orderBy("cluster_ord").collect()] == ["two", "one"]
    tables = parse_files(spark, [one, two])
    assert [r["name"] for r in tables["clusters"].orderBy("cluster_ord").collect()] == ["one", "two"]
    tables = parse_files(spark, [one, one, two, two])
    assert tables["clusters"].count() == 4 and tables["genes"].count() == 4
    with pytest.raises(TypeError):
        parse_files(spark, ["x.txt"])
    assert parse_files(spark, [])["genes"].collect() == []


def test_in_memory_records(spark):
    exon = [{"start": 0, "end": 66, "strand": 1}]
    tables = from_rows(spark, [{"record_id": "r", "record_name": "mine", "sequence": BASES, "features": [{"feature_ord": 0, "type": "CDS", "exons": exon, "qualifiers": [{"key": "gene", "value": "g"}]}]}])
    assert tables["clusters"].first()["name"] == "mine" and genes_of(tables, "label", "translation") == [("g", PROTEIN + "*")]


def test_side_inputs(spark, tmp_path):
    assert side_inputs.parse_ranges(["a:1-5", "b:2-3", "a:7-9"]) == {"a": (7, 9), "b": (2, 3)}
    for bad, error in (("a1-5", ValueError), ("a:b:1-5", ValueError), ("a:1-2-3", ValueError), ("a:15", ValueError), ("a:x-5", TypeError)):
        with pytest.raises(error):
            side_inputs.parse_range(bad)
    path = write(tmp_path, "f.csv", "g1,Cytochrome P450 \ng2,other\n\ng3,Cytochrome P450 \n")
    assert [(r["function"], r["genes"]) for r in side_inputs.read_functions(spark, path).orderBy("function_ord").collect()] == [("Cytochrome P450 ", ["g1", "g3"]), ("other", ["g2"])]
    path = write(tmp_path, "c.csv", "a,#FF0000\nb,#00FF00\na,#0000FF\n")
    assert {r["function"]: r["colour"] for r in side_inputs.read_colours(spark, path).collect()} == {"a": "#0000FF", "b": "#00FF00"}
    for text in ("only one\n", "a,b,c\n"):
        with pytest.raises(Exception, match="two fields"):
            side_inputs.read_functions(spark, write(tmp_path, "bad.csv", text)).collect()


def test_parents_at_any_depth_and_in_circles(spark):
    """Six levels between a coding row and its gene, and coding rows whose parents are their own ancestors."""
    from geneloom.sources import gff3

    def row(n, kind, start, end, name, parent=None):
        parents = {"ID": [name], **({"Parent": [parent]} if parent else {})}
        return (0, n, "r", kind, start, end, 1, parents)

    chain = [row(0, "gene", 1, 90, "g"), *(row(i, "part", 1, 90, f"p{i}", "g" if i == 1 else f"p{i - 1}") for i in range(1, 7)), row(7, "CDS", 10, 20, "c", "p6")]
    circle = [row(8, "part", 1, 90, "x", "y"), row(9, "part", 1, 90, "y", "x"), row(10, "CDS", 30, 40, "d", "x")]
    schema = "cluster_ord int, line_ord int, seqid string, type string, start int, end int, strand tinyint, attributes map<string,array<string>>"
    rows = spark.createDataFrame(chain + circle, schema)
    cds = rows.where("type = 'CDS'").withColumn("own_id", F.get(F.element_at("attributes", "ID"), F.lit(0)))
    found = {r["own_id"]: (r["gene_start"], r["gene_end"]) for r in gff3.parent_genes(rows, cds).collect()}
    assert found == {"c": (1, 90)}
