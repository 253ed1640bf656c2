"""Quotations of parts of a message."""

from pyspark.sql import functions as F

from loomgraph.llm import chat


def replies(spark, rows):
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    return {(r["conv_id"], r["turn"]): ((r["reply_conv"], r["reply_turn"]), (r["thread_conv"], r["thread_turn"]), r["depth"]) for r in got}


def test_partial_quotes(spark):
    first = "Line one is here\nline two is there\nline three ends\n\nSecond part. It has a middle sentence! And a last one.\n\nThird part stands alone"
    rows = [
        (1, 0, "user", first),
        (1, 1, "bot", "> line two is there\n> line three ends\nTwo of three lines."),
        (1, 2, "bot", "> Second part. It has a middle sentence! And a last one.\n>\n> Third part stands alone\nTwo of three paragraphs."),
        (1, 3, "bot", "> It has a middle sentence!\nOne sentence."),
        (1, 4, "bot", "> line three ends\n> line two is there\nNot in this order."),
        (1, 5, "bot", "> line two is there\n> nobody says this\nNot all of it."),
        (1, 6, "bot", "> line two is there line three\nHalf a line."),
        (2, 0, "bot", "> Line one is here\n> line three ends\nFrom elsewhere, with a line left out."),
    ]
    got = replies(spark, rows)
    for k in ((1, 1), (1, 2), (1, 3), (2, 0)):
        assert got[k] == ((1, 0), (1, 0), 1), k
    for k in ((1, 4), (1, 5), (1, 6)):
        assert got[k] == ((None, None), k, 0), k


def test_the_latest_earlier_message_that_holds_all_is_chosen(spark):
    rows = [(1, 0, "u", "Alpha beta. Gamma delta. Rest"), (1, 1, "u", "Gamma delta. Alpha beta. Rest"), (1, 2, "u", "x. Alpha beta. Gamma delta. y"), (1, 3, "u", "Alpha beta. Other"), (1, 4, "u", "> Alpha beta. Gamma delta.\nno"), (1, 5, "u", "Alpha beta. Gamma delta. Later")]
    assert replies(spark, rows)[1, 4][0] == (1, 2)


def test_rings_end_at_their_least_message(spark):
    rows = [(1, 0, "u", "alpha one\n> beta two"), (2, 0, "u", "beta two\n> gamma three"), (3, 0, "u", "gamma three\n> alpha one"), (4, 0, "u", "delta four\n> gamma three"), (5, 0, "u", "alone")]
    got = replies(spark, rows)
    assert {k: v[1:] for k, v in got.items()} == {(1, 0): ((1, 0), 0), (2, 0): ((1, 0), 0), (3, 0): ((1, 0), 0), (4, 0): ((1, 0), 0), (5, 0): ((5, 0), 0)}
    assert got[4, 0][0] == (3, 0)


def test_long_messages_and_long_conversations(spark):
    said = "\n".join(f"line number {i} of many" for i in range(3000))
    rows = [(1, 0, "u", said)] + [(1, t, "u", "> line number 7 of many\nsame again") for t in range(1, 400)] + [(2, 0, "u", "\n".join(f"{'>' * (i % 3)} word{i}" for i in range(4000)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("node", "root", "hash", "level", "starts__")})
    got = {(r["conv_id"], r["turn"]): r for r in chat.link(df, keep=["conv_id", "turn", "node", "root"]).collect()}
    assert len(got) == len(rows) and all(got[1, t]["reply_turn"] == 0 and got[1, t]["node"] == 1 for t in range(1, 400))
    assert got[2, 0]["n_quotes"] == 2666 and got[2, 0]["quote_level"] == 2
