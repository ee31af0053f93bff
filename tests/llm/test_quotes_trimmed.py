"""Trimmed and short quotes link to the turn they come from."""

from engramlake.llm import quotes


def test_trimmed_and_short_quotes(spark):
    said = "The first line has some words\nand the second line goes on\nthen a third line ends it\n\nA second paragraph stands here too\n\nFinally the third one says goodbye to all"
    rows = [
        (1, 0, said), (1, 1, "Something else entirely is said here"), (1, 2, "> The first line has some words\n> and the second line goes on\ntwo of three lines"),
        (1, 3, "> A second paragraph stands here too\n>\n> Finally the third one says goodbye to all\ntwo of three paragraphs"),
        (1, 4, "> second paragraph stands here\npart of a line"), (1, 5, "Sure thing"), (1, 6, "> sure thing\nshort"), (1, 7, "sure thing"),
        (1, 8, "> Sure thing\nwho said it"), (1, 9, "> nobody ever said these words\nno"), (2, 0, "> and the second line goes\nother conversation"),
    ]
    got = {(r.conv, r.turn): (r.n_quotes, r.n_linked, r.reply_to) for r in quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert {k: v for k, v in got.items() if v != (0, 0, None)} == {
        (1, 2): (1, 1, 0), (1, 3): (1, 1, 0), (1, 4): (1, 1, 0), (1, 6): (1, 1, 5), (1, 9): (1, 0, None), (2, 0): (1, 0, None),
    }
