from emberline.llm import line_dedup as L

DOCS = "doc_id long, text string, source string, n_lines string, hash string"


def result(df, **options):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in L.dedup_lines(df, **options).collect()}


def test_shared_lines_go_but_for_the_first(llm):
    rows = [(i, f"own {i}\nshared\n\nshared\nend {i % 2}", f"s{i}") for i in range(6)] + [(10, None, "s0"), (11, "", "s1"), (12, "shared", None), (13, "x\nshared", "s1")]
    got = result(llm.createDataFrame([(*r, "x", "y") for r in rows], DOCS), min_sites=6)
    assert got[0] == ("own 0\nshared\n\nend 0", 5, 1)
    assert got[3] == ("own 3\n\nend 1", 5, 2)
    assert got[10] == (None, 0, 0) and got[11] == ("", 1, 0) and got[12] == ("", 1, 1) and got[13] == ("x", 2, 1)


def test_threshold_is_exact_on_both_sides(llm):
    # lines on 1 to 40 sites, many times on each; a small sketch makes the estimates rough
    rows = [(n * 1000 + s, "\n".join([f"line {n}"] * 3), f"site {s}") for n in range(1, 41) for s in range(n)]
    got = result(llm.createDataFrame([(*r, "x", "y") for r in rows], DOCS), min_sites=17, lg_k=4)
    for n in range(1, 41):
        assert sum(got[n * 1000 + s][2] for s in range(n)) == (3 * n - 1 if n >= 17 else 0), n


def test_null_ids_repeats_and_empty(llm):
    rows = [(None, "a\nb", f"s{i}") for i in range(5)] + [(1, "a", "s1"), (1, "a", "s1")]
    df = llm.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    out = L.dedup_lines(df, min_sites=5).collect()
    assert len(out) == 7 and sum(r["n_removed"] for r in out if r["doc_id"] == 1) == 2
    assert L.dedup_lines(df.limit(0)).collect() == []
    assert "hash" in L.dedup_lines(df).columns and L.dedup_lines(df).columns.count("n_lines") == 1
