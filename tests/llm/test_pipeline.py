import corpus_pipeline as P
from geneloom.llm import sentence_pieces
from tests.llm import test_line_dedup, test_near_dedup
from tests.llm.fixtures import table

ITEM = " ".join(f"benchmark{i}" for i in range(20))


def corpus():
    prose = lambda k, n=80: "\n".join(" ".join(f"{chr(97 + (k * 7 + i * 3 + j) % 26)}w{k}x{i}y{j}" for j in range(10)) for i in range(n // 10))
    docs = [(k, prose(k)) for k in range(8)]
    docs.append((20, prose(0)))  # a copy: its lines go, and with them the document
    docs.append((21, prose(3).replace("\n", " ")))  # one long line, no line of it is like another: a near copy
    docs.append((22, prose(9) + "\n" + ITEM))
    docs.append((23, "junk *** " * 60))
    docs.append((24, prose(10) + "\n" + prose(1).split("\n")[0]))
    docs += [(25, None), (26, ""), (27, "short")]
    return docs


def test_each_stage_takes_effect(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, corpus()).drop("ids")
    assert {"kept", "id", "key", "n_lines", "removed"} <= set(docs.columns)  # columns of the table's own with names that operators use
    own = {r["doc_id"]: (r["kept"], r["n_lines"], r["removed"]) for r in docs.collect()}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns + (["ids"] if name == P.STAGES[-1][0] else [])
    every = {i for i, _ in corpus()}
    assert kept["quality_rules"] == every - {23, 25, 26, 27}
    assert kept["line_dedup"] == kept["quality_rules"] - {20}
    assert kept["near_dedup"] == kept["line_dedup"] - {21}
    assert kept["decontamination"] == kept["near_dedup"] - {22} == kept["sentence_pieces"]
    rows = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(rows) == kept["sentence_pieces"]
    assert all((r["kept"], r["n_lines"], r["removed"]) == own[i] for i, r in rows.items())
    assert "\n" in rows[24]["text"] and rows[24]["n_chars"] == len(rows[24]["text"]) < len(dict(corpus())[24])
    pieces = sentence_pieces.model(P.tokenizer_path("piece_bpe_32k.model"))
    import numpy as np

    assert all(pieces.decode(np.array(r["ids"], np.int32)) == r["text"] for r in rows.values())


def test_line_stage_matches_brute_force(spark):
    rows = corpus()
    expected = test_line_dedup.brute(rows)
    found = {r["doc_id"]: r["text"] for r in P.lines(spark, table(spark, rows), "").collect()}
    for i, t in rows:
        left = [x for n, x in enumerate((t or "").split("\n")) if n not in expected[i, t or ""]]
        if expected[i, t or ""] and not any(x.strip() for x in left):
            assert i not in found
        else:
            assert found[i] == (None if t is None else "\n".join(left))


def test_line_stage_takes_short_lines(spark):
    rows = test_line_dedup.short_lines()
    expected = test_line_dedup.brute(rows, least=1)
    found = {r["doc_id"]: r["text"] for r in P.lines(spark, table(spark, rows), "").collect()}
    left = {i: [x for n, x in enumerate(t.split("\n")) if n not in expected[i, t]] for i, t in rows}
    assert found == {i: "\n".join(left[i]) for i, t in rows if not expected[i, t] or any(x.strip() for x in left[i])}


def test_near_stage_matches_brute_force(spark):
    rows = corpus()
    expected = test_near_dedup.brute(rows, P.SHINGLE_WORDS, P.SIMILARITY)
    assert {r["doc_id"] for r in P.near_duplicates(spark, table(spark, rows), "").collect()} == {i for i in expected if expected[i] == i}
