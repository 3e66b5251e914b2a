"""What op8's one pass over the texts computes."""

from webquire.llm import line_templates as LT


def test_lines_are_masked_once(spark, monkeypatch):
    plans, cut = {}, LT.cut

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(LT, "cut", kept)
    docs = spark.createDataFrame([(1, "one two three four 5\nx"), (2, "one two three four 6\n\ny"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, LT.drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped").collect())) == [(1, 2, 0), (2, 3, 1), (3, 0, 0)]
    assert plans["lines"].count("regexp_replace") == 1


def test_leaves_of_one_block_need_no_rounds(spark, monkeypatch):
    """Their templates are linked where they are clustered: no tables of keys, no components."""
    names, cut = [], LT.cut

    def kept(df, name):
        names.append(name)
        return cut(df, name)

    monkeypatch.setattr(LT, "cut", kept)
    monkeypatch.setattr(LT, "components", None)
    # 40 and 20 are unlike until 30 joins the one and 10 the other
    lines = {40: "w x y z a b c d e f", 20: "w x y z g h c d i j", 30: "w x y z a b c d k l", 10: "w x y z g h c d k m", 50: "w x y z n o p q r s"}
    rows = [(1, v, words, 9 - i) for i, (v, words) in enumerate(lines.items())] + [(2, 60, "alone", 1)]
    got = {r.v: r.top for r in LT.clusters(spark.createDataFrame(rows, "leaf long, v long, words string, n long")).collect()}
    assert got == {40: 20, 30: 20, 20: 20, 10: 20, 50: 50, 60: 60}
    assert "line-keys" not in names


def test_links_of_a_group_are_a_star(spark):
    """A chain of similar lines gives edges from its smallest name alone, so rounds do not grow with its length."""
    lines = [" ".join(["w", "x", "y", "z", *("b" if j < i else "a" for j in range(12))]) for i in range(0, 13, 3)]
    rows = [(1, 0, 0, 0, 0, 100 - i, words) for i, words in enumerate(lines)]
    groups = spark.createDataFrame(rows, "leaf long, key long, p int, q int, own int, v long, words string")
    assert sorted(map(tuple, LT.compare_blocks(groups).collect())) == [(96, 97), (96, 98), (96, 99), (96, 100)]
