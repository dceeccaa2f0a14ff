"""The published golden rules for English sentence splitting, as a table, and properties on any text."""

import time

import pytest
from pyspark.sql import functions as F

from tessella.operators import segment
from tessella.operators.sentence_rules import ruled_sentences, sentences_by_rules

# Sentences are divided by | here.
GOLDEN = """
Hello World.|My name is Jonas.
What is your name?|My name is Jonas.
There it is!|I found it.
My name is Jonas E. Smith.
Please turn to p. 55.
Were Jane and co. at the party?
They closed the deal with Pitt, Briggs & Co. at noon.
Let's ask Jane and co.|They should know.
They closed the deal with Pitt, Briggs & Co.|It closed yesterday.
I can see Mt. Fuji from here.
St. Michael's Church is on 5th st. near the light.
That is JFK Jr.'s book.
I visited the U.S.A. last year.
I live in the E.U.|How about you?
I live in the U.S.|How about you?
I work for the U.S. Government in Virginia.
I have lived in the U.S. for 20 years.
At 5 a.m. Mr. Smith went to the bank.|He left the bank at 6 P.M.|Mr. Smith then went to the store.
She has $100.00 in her bag.
She has $100.00.|It is in her bag.
He teaches science (He previously worked for 5 years as an engineer.) at the local University.
Her email is Jane.Doe@example.com.|I sent her an email.
The site is: https://www.example.50.com/new-site/awesome_content.html.|Please check it out.
She turned to him, 'This is great.' she said.
She turned to him, "This is great." she said.
She turned to him, "This is great."|She held the book out to show him.
Hello!!|Long time no see.
Hello??|Who is there?
Hello!?|Is that you?
Hello?!|Is that you?
1.) The first item|2.) The second item
1.) The first item.|2.) The second item.
1) The first item|2) The second item
1) The first item.|2) The second item.
1. The first item|2. The second item
1. The first item.|2. The second item.
• 9. The first item|• 10. The second item
⁃9. The first item|⁃10. The second item
a. The first item|b. The second item|c. The third list item
You can find it at N°. 1026.253.553.|That is where the treasure is.
She works at Yahoo! in the accounting department.
We make a good team, you and I.|Did you see Albert I. Jones yesterday?
Thoreau argues that by simplifying one’s life, “the laws of the universe will appear less complex. . . .”
"Bohr [...] used the analogy of parallel stairways [...]" (Smith 55).
If words are left off at the end of a sentence, and that is all that is omitted, indicate the omission with ellipsis marks (preceded and followed by a space) and then indicate the end of the sentence with a period . . . .|Next sentence.
I never meant that....|She left the store.
I wasn't really ... well, what I mean...see . . . what I'm saying, the thing is . . . I didn't mean it.
One further habit which was somewhat weakened . . . was that of combining words into self-interpreting compounds.|. . . The practice was not abandoned. . . .
""".strip().split("\n")


@pytest.mark.parametrize("line", GOLDEN)
def test_golden(line):
    want = line.split("|")
    text = " ".join(want)
    got = ruled_sentences(text)
    assert [c for c, _, _ in got] == want and all(text[s:e] == c for c, s, e in got)


def test_lines_and_no_white_space():
    assert [c for c, _, _ in ruled_sentences("features\ncontact manager\nevents, activities\n")] == ["features", "contact manager", "events, activities"]
    for text in ("This is a sentence\ncut off in the middle because pdf.", "It was a cold \nnight in the city."):
        assert [c for c, _, _ in ruled_sentences(text, join_lines=True)] == [text] and len(ruled_sentences(text)) == 2
    assert [c for c, _, _ in ruled_sentences("Hello world.Today is Tuesday.Mr. Smith went to the store and bought 1,000.That is a lot.")] == [
        "Hello world.", "Today is Tuesday.", "Mr. Smith went to the store and bought 1,000.", "That is a lot."]
    assert [c for c, _, _ in ruled_sentences("First line\nSecond. Third", join_lines=True)] == ["First line", "Second.", "Third"]


ODD = ["", None, " \n\t ", ".", "...", "a", "\"unclosed. Quote", "(open. [Brackets", "'tis. The 'a 'b", "1. 2. 3.", "• •", "é. É. Ünder.", "x" * 50 + ". Y", "　。 次", "A. B. C. D."]


@pytest.mark.parametrize("text", ODD)
def test_all_but_white_space_is_kept(text):
    got = ruled_sentences(text)
    assert "".join("".join(c.split()) for c, _, _ in got) == "".join((text or "").split())
    assert all(text[s:e] == c and c.strip() for c, s, e in got) and all(a[2] <= b[1] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("unit", ["Hello World. ", "'a ", "\"x", "(", "[(", "1. ", ". ", "...", "a@b.", "http://x.", "e.g. A.", "• ", "\n", "Mr. X's 'q' \"", ". . . ", "„“ ", "a.", "w+-"])
def test_time_is_linear(unit):
    def took(n):
        text = unit * (n // len(unit))
        began = time.perf_counter()
        ruled_sentences(text)
        return time.perf_counter() - began

    took(10_000)
    assert took(400_000) < 12 * took(100_000) + 0.3


def test_column_and_chunks(spark):
    text = "Dr. Who met Mr. X. They left (at 5 p.m. or so). Bye!"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, content string")
    rows = {r["id"]: [x["content"] for x in r["s"]] for r in df.select("id", sentences_by_rules(F.col("content")).alias("s")).collect()}
    assert rows == {1: ["Dr. Who met Mr. X. They left (at 5 p.m. or so).", "Bye!"], 2: []}
    chunks = segment.chunk_rows(df, 60, 0, sentences_by_rules).collect()
    assert "".join(c["content"].replace(" ", "") for c in chunks) == text.replace(" ", "")
