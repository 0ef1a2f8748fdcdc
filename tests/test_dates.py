"""Dates in questions, in wordings that people use."""

import pytest

from stormlake.operators.questions import find_names, parse_questions, resolve_questions
from stormlake.operators.retrieve import match_names

OPEN = "2199-12-31T23:59:59"

WORDINGS = [
    # one day
    ("Where was Trami on 2024-10-28?", "2024-10-28, None"),
    ("Where was Trami on October 28, 2024?", "2024-10-28, None"),
    ("Where was Trami on 28th Oct 2024?", "2024-10-28, None"),
    ("Where was Trami on the 28th of October, 2024 at 6:30 pm?", "2024-10-28T18:30:00, None"),
    ("Where was Trami on Oct. 28 2024, at 6 a.m.?", "2024-10-28T06:00:00, None"),
    ("At 1pm on 28 Oct 2024, where was Trami?", "2024-10-28T13:00:00, None"),
    ("Where was Trami on Monday, 28 Oct 2024 at noon?", "2024-10-28T12:00:00, None"),
    ("What is position of Typhoon Trami on 2024-08-30T12:00:00?", "2024-08-30T12:00:00, None"),
    ("Where was Trami at 13:00 on 2024-10-28?", "2024-10-28T13:00:00, None"),
    ("WHERE WAS TRAMI ON MAY 5, 2024?", "2024-05-05, None"),
    # ranges that share what they leave out
    ("Trami from 27 to 29 Oct 2024", "2024-10-27, 2024-10-29"),
    ("Trami from October 27 to 29, 2024", "2024-10-27, 2024-10-29"),
    ("Trami, Oct 27-29, 2024", "2024-10-27, 2024-10-29"),
    ("Trami between 27th and 29th October 2024", "2024-10-27, 2024-10-29"),
    ("Trami from 27 Oct to 2 Nov 2024", "2024-10-27, 2024-11-02"),
    ("Trami from 27 Oct 2024 to 29 Oct", "2024-10-27, 2024-10-29"),
    ("Trami from 31 Dec to 2 Jan 2024", "2023-12-31, 2024-01-02"),
    ("Trami on 28 Oct 2024 from 1pm to 5pm", "2024-10-28T13:00:00, 2024-10-28T17:00:00"),
    ("Trami from 1pm to 5pm on 28 Oct 2024", "2024-10-28T13:00:00, 2024-10-28T17:00:00"),
    ("Trami through 29 Oct 2024 from 27 Oct 2024", "2024-10-27, 2024-10-29"),
    ("Trami from 27 Oct 2024 to the end of 28 Oct 2024", "2024-10-27, 2024-10-28T23:59:00"),
    # open windows
    ("Where did Trami go after 3 Jan 2024?", f"2024-01-04, {OPEN}"),
    ("Where did Trami go after 31 Dec 2023 6pm?", f"2023-12-31T18:00:01, {OPEN}"),
    ("Where did Trami go since 3 Jan 2024?", f"2024-01-03, {OPEN}"),
    ("Where did Trami go since 3 Jan 2024 until now?", f"2024-01-03, {OPEN}"),
    ("Where was Trami before 1 Mar 2024?", "None, 2024-02-29T23:59:59"),
    ("Where was Trami before 1 Mar 2024 6am?", "None, 2024-03-01T05:59:59"),
    ("Where was Trami after 1 Jan 2024 and before 4 Jan 2024?", "2024-01-02, 2024-01-03T23:59:59"),
    # more than two
    ("Trami on Oct 27 to 29, 2024 and then 3 Nov 2024", "2024-10-27, 2024-10-29, 2024-11-03"),
    # no date
    ("Where may Trami be?", "None, None"),
    ("Where was Trami at 1pm?", "None, None"),
    ("Did Trami march with 12 storms to 5 islands?", "None, None"),
    ("On 28 Oct 2024 were there 5 to 6 storms like Trami?", "2024-10-28, None"),
    # seen, not understood
    ("Where was Trami in October 2024?", "?"),
    ("Where was Trami on 28 Oct?", "?"),
    ("Where was Trami on 10/28/2024?", "?"),
    ("Where was Trami yesterday?", "?"),
    # a day that does not exist is a date, and no time
    ("Where was Trami on 30 Feb 2024?", "2024-02-30, None"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    questions = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(WORDINGS)], "question_id long, question string")
    names = spark.createDataFrame([("TRAMI",)], "TyphoonName string")
    found = parse_questions(questions, names)
    _, failed = resolve_questions(found)
    return {r.question_id: r.parsed for r in found.collect()}, {r.question_id for r in failed.collect()}


@pytest.mark.parametrize("number", range(len(WORDINGS)), ids=[q for q, _ in WORDINGS])
def test_wordings(parsed, number):
    assert parsed[0][number].casefold() == f"Trami, {WORDINGS[number][1]}".casefold()


def test_what_is_not_understood_fails_the_gate(parsed):
    rejected = {i for i, (_, want) in enumerate(WORDINGS) if want == "?" or want.count(", ") > 1}
    assert parsed[1] == rejected


def test_no_question_and_no_words(spark):
    questions = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "2024"), (5, "to until and")], "question_id long, question string")
    names = spark.createDataFrame([("TRAMI",)], "TyphoonName string")
    assert {r.parsed for r in parse_questions(questions, names).collect()} == {"None, None, None"}


def test_a_name_with_an_apostrophe_is_found_and_matched(spark):
    names = spark.createDataFrame([("O'HARE",), ("KONG-REY",)], "TyphoonName string")
    questions = spark.createDataFrame([(1, "Where is O'Hare?"), (2, "Where is O’Hare now?")], "question_id long, question string")
    found = {r.question_id: r["name"] for r in find_names(questions, names).collect()}
    assert found == {1: "O Hare", 2: "O Hare"}
    matched = match_names(spark.createDataFrame([("O HARE",)], "name string"), names).collect()
    assert [r.TyphoonName for r in matched] == ["O'HARE"]
