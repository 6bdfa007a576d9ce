from collections import Counter

from deskloom.llm.line_dedup import drop_recurring_lines

PROSE = [" ".join(w + chr(97 + i % 26) + chr(97 + i // 26) for w in ("unique", "prose", "line", "of", "text")) for i in range(40)]


def cleaned(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = drop_recurring_lines(df, **options).collect()
    return {r["doc_id"]: r["text"] for r in rows}


def test_variable_fields_are_one_template(spark):
    stamps = [f"Posted on 2024-01-{i:02d} at {i}:30 by staff" for i in range(1, 9)]
    names = [f"All articles of this week were written by {n}" for n in ("ann", "bo", "cy", "di", "ed", "flo")]
    texts = [f"{PROSE[i]}\n{stamps[i]}\n  {names[i % 6]} \n{PROSE[i + 10]}" for i in range(8)]
    out = cleaned(spark, texts)
    assert out[0] == texts[0]  # the first document keeps what recurs
    assert all(out[i] == f"{PROSE[i]}\n{PROSE[i + 10]}" for i in range(1, 8))


def test_rare_and_short_lines_and_prose_stay(spark):
    line = "this line is in four documents only"
    texts = [f"Read more\n{PROSE[i]}" + (f"\n{line}" if i < 4 else "") for i in range(8)]
    texts += [f"the cat sat {a} {b} {c}" for a, b, c in ("abc", "def", "ghi", "jkl", "mno", "pqr")]
    out = cleaned(spark, texts)
    assert [out[i] for i in range(len(texts))] == texts


def test_short_lines_recur_too(spark):
    """Lines of one to three tokens, or without spaces, go by their exact text and a higher count."""
    texts = [f"{PROSE[i]}\n All  rights reserved.\nRead more\n版权所有。\npage {i} end" for i in range(12)]
    texts += [f"{PROSE[20 + i]}\nfew" for i in range(9)]
    out = cleaned(spark, texts)
    assert out[0] == texts[0] and [out[i] for i in range(12, 21)] == texts[12:]
    assert all(out[i] == f"{PROSE[i]}\npage {i} end" for i in range(1, 12))
    lower = cleaned(spark, texts, short_docs=9)
    assert lower[12] == texts[12] and all(lower[i] == PROSE[i + 8] for i in range(13, 21))


def test_columns_that_clash_but_for_case(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d", 9, 9)], "doc_id long, text string, N_Lines int, Copy int")
    drop_recurring_lines(df).write.parquet(str(tmp_path / "lines"))
    assert spark.read.parquet(str(tmp_path / "lines")).columns == ["doc_id", "text", "Copy", "n_lines", "n_dropped"]


def test_tables_of_numbers_are_no_template(spark):
    texts = [f"{i} {i + 1} {i + 2} {i + 3} {i + 4}\n{PROSE[i]}" for i in range(20)]
    assert sorted(cleaned(spark, texts).values()) == sorted(texts)


def test_copies_count_as_one_document(spark):
    text = "\n".join(PROSE[:5])
    out = cleaned(spark, [text] * 12 + [PROSE[0] + "\nx"])
    assert set(out.values()) == {text, PROSE[0] + "\nx"}


def test_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumnRenamed("digest", "n_dropped")
    out = drop_recurring_lines(clash)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((r["doc_id"], r["text"]) for r in clash.collect())
    assert {r["n_lines"] for r in out.where("text is null").collect()} == {0}
    assert drop_recurring_lines(no_docs).collect() == []


def test_repeated_rows_and_null_ids(spark):
    line = "a line that recurs in many documents"
    rows = [(None, f"{line}\nx{i}") for i in range(3)] + [(i, f"{line}\ny{i}") for i in range(4)] + [(3, f"{line}\ny3")] * 2
    out = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r["n_dropped"] == 0 for r in out.collect()) == 1  # one of the null ids comes first
    assert Counter(r["text"] for r in out.collect())["y3"] == 3
