import json
import os
import threading
import urllib.request

import pytest

from geneloom import cli, figure, report
from geneloom.operators.alignment import AlignConfig
from geneloom.session import Session, align_clusters, parse_files, read_session
from geneloom.streaming.incremental import scores_of_stream, watch
from tests.fixtures import BASES, clusters, feature, genbank, write


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    return clusters(tmp_path_factory.mktemp("clusters"))


@pytest.fixture(scope="module")
def session(spark, paths):
    s = align_clusters(spark, parse_files(spark, paths))
    s.build_groups()
    return s


def labels(s):
    name = {r["gene_id"]: r["label"] for r in s.genes.collect()}
    return sorted((name[r["query_gene_id"]], name[r["target_gene_id"]], round(r["identity"], 6)) for r in s.links.collect())


def test_links_and_matrix(session):
    found = labels(session)
    assert [(q, t) for q, t, _ in found] == [("A1", "B1"), ("A2", "B2")]
    assert found[0][2] == round(62 / 63, 6) and found[1][2] == round(44 / 45, 6)
    assert session.alignments.count() == 3  # pairs without links have an alignment too
    m = {(r["i"], r["j"]): r["value"] for r in session.matrix(True, True).collect()}
    assert m[0, 1] == 0 and m[0, 2] == m[2, 1] == 1
    assert sorted(session.order()) == [0, 1, 2] and session.order()[0] in (2, 0, 1)
    assert {r["label"] for r in session.groups.collect()} == {"Group 0", "Group 1"}


def test_report(session):
    text = report.format_report(session, decimals=2)
    blocks = text.split("\n\n")
    assert blocks[0] == "alpha vs beta\n-------------\nQuery  Target  Identity  Similarity\nA1     B1      0.98      1.00      \nA2     B2      0.98      1.00      "
    assert blocks[1] == "alpha vs gamma\n--------------\nQuery  Target  Identity  Similarity" and len(blocks) == 3
    plain = report.format_report(session, 3, False, False, ",")
    assert plain.split("\n\n")[0] == "A1,B1,0.984,1.000\nA2,B2,0.978,1.000"
    lines = report.format_matrix(session, normalise=True, as_distance=True).split("\n")
    assert lines[0] == ",alpha,beta,gamma" and lines[1] == "alpha,0.0,0.0,1.0"
    with pytest.raises(ValueError):
        report.format_report(Session(session.spark))


def test_report_as_files(spark, session, tmp_path):
    report.write_blocks(session, str(tmp_path / "out"), decimals=2)
    files = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part-"))
    text = "".join((tmp_path / "out" / f).read_text() for f in files)
    assert text.rstrip("\n") == report.format_report(session, 2)


def test_exchange_form_round_trips(spark, session, tmp_path):
    path = str(tmp_path / "s.json")
    session.save(path, indent=1)
    again = Session.load(spark, path)
    assert again.to_dict() == session.to_dict()
    d = json.loads((tmp_path / "s.json").read_text())
    assert list(d) == ["order", "clusters", "loci", "genes", "groups", "alignments", "links"]
    by_spark = Session(spark, read_session(spark, path))
    assert by_spark.to_dict() == session.to_dict()
    del d["groups"]
    assert Session.from_dict(spark, d).groups.count() == 0
    session.write_parquet(str(tmp_path / "tables"))
    assert Session.read_parquet(spark, str(tmp_path / "tables")).to_dict() == session.to_dict()


def test_adding_clusters_equals_starting_over(spark, paths, session):
    s = Session(spark)
    for p in paths:
        s.add_clusters(parse_files(spark, [p]))
        s.align()
    assert labels(s) == labels(session)
    assert [r["name"] for r in s.clusters.orderBy("cluster_ord").collect()] == ["alpha", "beta", "gamma"]
    n = s.alignments.count()
    s.align()
    assert s.alignments.count() == n == 3
    name = {r["cluster_id"]: r["name"] for r in s.clusters.collect()}
    assert [(name[r["query_cluster_id"]], name[r["target_cluster_id"]]) for r in s.alignments.orderBy("alignment_ord").collect()] == [("alpha", "beta"), ("alpha", "gamma"), ("beta", "gamma")]


def test_replacing_an_alignment(spark, session):
    s = Session(spark, dict(session.tables))
    first = session.alignments.orderBy("alignment_ord").first()
    turned = spark.createDataFrame([("new", 9, first["target_cluster_id"], first["query_cluster_id"])], session.alignments.schema)
    s.put_alignments(turned, s.links.limit(0))
    assert s.alignments.count() == 3 and s.links.count() == 0


def test_functions(spark, paths, tmp_path):
    from geneloom.sources.side_inputs import read_colours, read_functions

    s = align_clusters(spark, parse_files(spark, paths))
    functions = read_functions(spark, write(tmp_path, "f.csv", "a1,Kinase\nC1,Other\nmissing,Nothing\n"))
    s.build_groups(functions, read_colours(spark, write(tmp_path, "c.csv", "Kinase,#ff0000\n")))
    name = {r["gene_id"]: r["label"] for r in s.genes.collect()}
    held: dict = {}
    for r in s.group_members.collect():
        held.setdefault(r["group_id"], set()).add(name[r["gene_id"]])
    found = [(g["label"], held.get(g["group_id"], set()), g["colour"]) for g in s.groups.orderBy("group_ord").collect()]
    # a1 is a name of the gene feature only, so no gene has it
    assert found == [("Kinase", set(), "#ff0000"), ("Other", {"C1"}, None), ("Nothing", set(), None), ("Group 3", {"A1", "B1"}, None), ("Group 4", {"A2", "B2"}, None)]


def test_config(spark):
    s = Session(spark)
    s.configure_aligner(mode="local")
    assert s.config == AlignConfig(mode="local")
    with pytest.raises(ValueError):
        s.configure_aligner(speed=3)


def test_figure(session, tmp_path):
    data = figure.figure_data(session, use_file_order=True)
    assert [c["name"] for c in data["clusters"]] == ["alpha", "beta", "gamma"] and len(data["links"]) == 2
    assert data["clusters"][0]["loci"][0]["genes"][0]["label"] == "A1"
    figure.plot_clusters(session, str(tmp_path / "p.html"))
    page = (tmp_path / "p.html").read_text()
    assert page.startswith("<!DOCTYPE html>") and '"clusters"' in page and "</script>" in page
    assert "<\\/s>" in figure.page({"x": "</s>"})
    own = figure.server(data)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{own.server_port}"
        assert json.load(urllib.request.urlopen(base + "/data.json")) == json.loads(json.dumps(data))
        assert b"fetch('/data.json')" in urllib.request.urlopen(base + "/").read()
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(base + "/other")
    finally:
        own.shutdown()


def test_command_line(spark, paths, tmp_path, capsys):
    run = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    out, matrix, stored = tmp_path / "o.txt", tmp_path / "m.csv", tmp_path / "s.json"
    run(*paths[:2], "-s", stored, "-o", out, "-mo", matrix, "-p", tmp_path / "f.html", "-ufo", "-ji", 2)
    assert out.read_text().startswith("alpha vs beta") and matrix.read_text().startswith(",alpha,beta") and (tmp_path / "f.html").exists()
    s = run(paths[2], "-s", stored, "-dl", ";", "-ha", "-hl", "-dc", 1)
    assert "A1;B1;1.0;1.0" in capsys.readouterr().out and s.clusters.count() == 3
    assert run("-s", stored).alignments.count() == 3
    out.write_text("kept")
    run("-s", stored, "-o", out)
    assert out.read_text() == "kept"
    run("-s", stored, "-o", out, "-f")
    assert out.read_text() != "kept"
    assert run(*paths, "-na").alignments.count() == 0
    assert run(paths[0]).groups.count() == 0
    assert run("-p", tmp_path / "blank.html") is None and '"clusters": []' in (tmp_path / "blank.html").read_text()
    for bad in ((), (tmp_path / "missing.gbk",)):
        with pytest.raises(SystemExit):
            run(*bad)


def test_watching_a_folder(spark, paths, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    s = Session(spark)
    for i, p in enumerate(paths):
        (folder / os.path.basename(p)).write_text(open(p).read())
        watch(spark, str(folder), s, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination(120)
        assert s.clusters.count() == i + 1
    assert s.alignments.count() == 3 and s.links.count() == 2
    assert Session.read_parquet(spark, str(tmp_path / "store" / "batch=2")).links.count() == 2


def test_scores_of_a_stream(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1, 10)
    spark.createDataFrame([("x", 0.5, t0), ("x", 0.25, t0 + dt.timedelta(minutes=5)), ("x", 1.0, t0 + dt.timedelta(hours=2)), ("y", 0.1, t0 + dt.timedelta(hours=9))], "alignment_id string, identity double, at timestamp").write.parquet(str(tmp_path / "links"))
    stream = spark.readStream.schema("alignment_id string, identity double, at timestamp").parquet(str(tmp_path / "links"))
    query = scores_of_stream(stream).writeStream.format("memory").queryName("scores").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["alignment_id"], r["cumulative"], r["n"]) for r in spark.table("scores").collect())[:2] == [("x", 0.75, 2), ("x", 1.0, 1)]


def test_one_cluster_without_sequences(spark, tmp_path):
    path = write(tmp_path, "n.gbk", genbank("N", None, [feature("CDS", "1..9", protein_id="n1")], length=9) + genbank("M", BASES, []))
    s = align_clusters(spark, parse_files(spark, [path]))
    s.build_groups()
    assert s.genes.first()["translation"] == "" and s.alignments.count() == s.groups.count() == 0 and s.order() == [0]
