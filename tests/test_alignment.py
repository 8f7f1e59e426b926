import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geneloom.functions import columns as C
from geneloom.functions import matrices
from geneloom.operators.alignment import AlignConfig, Aligner, align_pairs, register

LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
sequences = st.text(LETTERS, min_size=1, max_size=25)


def scalar_score(a: str, b: str, config: AlignConfig, scores: dict[str, float]) -> float:
    """Affine-gap score by the plain three-state recurrence."""
    low, local = float("-inf"), config.mode == "local"
    n, m = len(a), len(b)
    both, up, left = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    both[0][0], best = 0.0, 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                came = max(both[i - 1][j - 1], up[i - 1][j - 1], left[i - 1][j - 1])
                both[i][j] = (max(came, 0.0) if local else came) + scores[a[i - 1] + b[j - 1]]
                best = max(best, both[i][j])
            if i:
                up[i][j] = max(both[i - 1][j] + config.open_gap_score, left[i - 1][j] + config.open_gap_score, up[i - 1][j] + config.extend_gap_score)
            if j:
                left[i][j] = max(both[i][j - 1] + config.open_gap_score, up[i][j - 1] + config.open_gap_score, left[i][j - 1] + config.extend_gap_score)
    return best if local else max(both[n][m], up[n][m], left[n][m])


@pytest.mark.parametrize("mode", ["global", "local"])
def test_scores_are_optimal(mode):
    config = AlignConfig(mode=mode)
    aligner, scores = Aligner(config), matrices.extend(matrices.blosum62())

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.tuples(sequences, sequences), min_size=1, max_size=6))
    def check(pairs):
        for (a, b), (score, identity, similarity, columns) in zip(pairs, aligner.align(pairs)):
            assert score == scalar_score(a, b, config, scores)
            assert 0 <= identity <= similarity <= 1
            if mode == "global":
                assert max(len(a), len(b)) <= columns <= len(a) + len(b)
                assert identity <= min(len(a), len(b)) / max(len(a), len(b))  # the length bound drops no pair that passes

    check()


def test_a_sequence_is_identical_to_itself():
    text = "MKVLAATTGGHERQ" * 20
    assert Aligner(AlignConfig()).align([(text, text)])[0][1:] == (1.0, 1.0, len(text))


def test_identity_counts_gap_columns_and_similar_letters():
    # AV-G / AVWG with one gap; then L and I are alike but not equal
    config = AlignConfig(open_gap_score=-1.0)
    (gap, alike) = Aligner(config).align([("AVG", "AVWG"), ("AL", "AI")])
    assert gap[1] == 3 / 4 and gap[3] == 4
    assert alike[1:] == (0.5, 1.0, 2)


def test_batches_do_not_change_results():
    pairs = [("MKV" * n, "MKI" * (n + 1)) for n in range(1, 12)]
    aligner = Aligner(AlignConfig())
    assert aligner.align(pairs) == [aligner.align([p])[0] for p in pairs]


def test_config():
    assert AlignConfig().configured(mode="local").mode == "local"
    with pytest.raises(ValueError, match="open_gap_score"):
        AlignConfig().configured(gap=1)
    with pytest.raises(ValueError):
        Aligner(AlignConfig()).align([("mkv", "MKV")])  # lower case isn't in the matrix
    assert matrices.named("PAM0") == matrices.blosum62()


def test_matrix_is_symmetric_and_extended():
    m = matrices.extend(matrices.blosum62())
    assert all(m[a + b] == m[b + a] for a, b in m)
    assert m["WW"] == 11 and m["*A"] == -4 and m["JA"] == m["OU"] == m["-A"] == 0
    assert matrices.parse_matrix("# x\n   A  B\nA  1 -2\nB -2  3\n") == {"AA": 1, "AB": -2, "BA": -2, "BB": 3}


def test_align_pairs_cutoff_and_sql(spark):
    pairs = spark.createDataFrame([(1, "MKVA", "MKVA"), (2, "MKVA", "WWWW")], "i int, sequence_a string, sequence_b string")
    assert [r["i"] for r in align_pairs(pairs, AlignConfig(), cutoff=0.5).collect()] == [1]
    register(spark)
    assert spark.sql("SELECT global_align('MKVA', 'MKVA').identity AS x").first()["x"] == 1.0


def test_aligned_strings(spark):
    rows = spark.createDataFrame([("AL-W-", "AI-W.")], "a string, b string").select(C.aligned_identity(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert (rows["identity"], rows["similarity"]) == (2 / 3, 1.0)
