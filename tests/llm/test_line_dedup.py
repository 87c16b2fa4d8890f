from wakeline.llm import line_dedup as L

from .conftest import BLANKS, odd_texts


def brute(rows, least):
    """Deletes every line inside a run of enough words that also starts earlier; rows with equal id and text are one."""
    unique = list(dict.fromkeys(rows))
    # null ids last, then the order of the operator among equal ids doesn't matter for these texts
    order = sorted(unique, key=lambda r: (r[0] is None, r[0] or 0))
    seqs = [[(i, x.strip(BLANKS)) for i, x in enumerate((t or "").split("\n")) if x.strip(BLANKS)] for _, t in order]
    first, gone = {}, [set() for _ in order]
    for d, seq in enumerate(seqs):
        for s in range(len(seq)):
            run = ()
            for e in range(s, min(len(seq), s + 60)):
                run += (seq[e][1],)
                place = first.setdefault(run, (d, s))
                if place == (d, s):
                    continue
                if sum(len(x.split()) for x in run) >= least:
                    gone[d].update(seq[k][0] for k in range(s, e + 1))
    out = {}
    for (d, t), lost in zip(order, gone):
        out[d, t] = (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost), len(lost))
    return sorted((str(d), str(t), str(out[d, t])) for d, t in rows)


def check(spark, rows, least):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.drop_repeated_lines(docs.withColumnRenamed("text", "t").selectExpr("doc_id", "t", "t AS text"), least).collect()
    assert sorted((str(r.doc_id), str(r.t), str((r.text, r._lines_deleted))) for r in got) == brute(rows, least)


def test_odd_texts(spark):
    check(spark, odd_texts(), 20)
    check(spark, odd_texts(), 3)


def test_overlaps_chains_and_ends(spark):
    a, b, c, d, e = "one two three", "four five", "six seven eight nine", "ten", "eleven twelve"
    texts = [[a, b, c, d, e], ["x", b, c, d, "y"], [c, d, e], [d, e, a, b], [a, b, c], [b] * 9, [a, b, a, b, a, b], ["", f" {a} ", "", b, c], [d] * 30, ["z"] + [d] * 12]
    check(spark, [(i, "\n".join(t)) for i, t in enumerate(texts)], 6)
    check(spark, [(i, "\n".join(t)) for i, t in enumerate(texts)], 1)
    check(spark, [(len(texts) - i, "\n".join(t)) for i, t in enumerate(texts)], 9)


def test_large_lists_join_by_sorting(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_BYTES", -1)
    check(spark, odd_texts(), 20)


def test_long_copy_without_doubling_to_its_length(spark):
    lines = [f"line number {i} of a long text" for i in range(400)]
    check(spark, [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join(["start", *lines[100:300], "end"]))], 20)


def test_nothing_repeats_and_no_rows(spark, no_documents, odd):
    check(spark, [(1, "a b c"), (2, "d e f")], 2)
    assert L.drop_repeated_lines(no_documents).count() == 0
    assert L.drop_repeated_lines(odd).columns == [*odd.columns, "_lines_deleted"]
