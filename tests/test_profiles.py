import json

import pytest

from pairwell.operators.profiles import extract_profiles, read_replies, rejected_profiles, valid_profiles

RESUME = """# An Nguyen, data engineer

## Skills:
- Python
- SQL; Spark, Kafka

## Summary
Builds pipelines.

Second paragraph.
## Work history
"""


def test_sections(spark):
    rows = [(1, RESUME), (2, "Plain text\nwithout sections"), (3, "  \n"), (4, None)]
    found = extract_profiles(spark.createDataFrame(rows, "cv_id int, text string"), "text")
    (good,) = valid_profiles(found, "cv_id").collect()
    assert good.asDict() == {
        "cv_id": 1,
        "title": "An Nguyen, data engineer",
        "skills": ["Python", "SQL", "Spark", "Kafka"],
        "description": "Builds pipelines.\n\nSecond paragraph.",
        "experience": "N/A",
    }
    reasons = {r.cv_id: r.reason for r in rejected_profiles(found, "cv_id").collect()}
    assert reasons[2] == "missing or wrong: skills, description"
    assert reasons[3] == reasons[4] == "missing or wrong: title, skills, description"


def test_replies(spark):
    good = {"title": "t", "skills": ["a", "b"], "description": "", "experience": "e"}
    rows = [
        (1, json.dumps(good)),
        (2, json.dumps(good | {"experience": ""})),
        (3, json.dumps({k: v for k, v in good.items() if k != "experience"} | {"skills": []})),
        (4, json.dumps(good | {"skills": "a, b"})),
        (5, json.dumps(good | {"skills": ["a", 1], "title": 3})),
        (6, "[]"),
        (7, "Sure! {"),
        (8, None),
        (9, json.dumps(good | {"experience": 4})),
    ]
    found = read_replies(spark.createDataFrame(rows, "cv_id int, reply string"), "reply")
    profiles = {r.cv_id: r for r in valid_profiles(found, "cv_id").collect()}
    assert {k: r.experience for k, r in profiles.items()} == {1: "e", 2: "N/A", 3: "N/A"}
    assert profiles[3].skills == [] and profiles[1].description == ""
    assert {r.cv_id: r.reason for r in rejected_profiles(found, "cv_id").collect()} == {
        4: "missing or wrong: skills",
        5: "missing or wrong: title, skills",
        6: "not a JSON object",
        7: "not a JSON object",
        8: "not a JSON object",
        9: "missing or wrong: experience",
    }


def test_model_extractor_is_set_up_per_task(spark):
    def factory():
        import json as codec

        def ask(texts):
            return [codec.dumps({"title": t, "skills": [t], "description": t}) if t else "{}" for t in texts]

        return ask

    frame = spark.createDataFrame([(1, "x"), (2, "")], "cv_id int, text string")
    found = extract_profiles(frame, "text", factory)
    assert [r.title for r in valid_profiles(found, "cv_id").collect()] == ["x"]
    assert rejected_profiles(found, "cv_id").first().reason == "missing or wrong: title, skills, description"


def test_unknown_extractor(spark):
    with pytest.raises(ValueError, match="unknown extractor"):
        extract_profiles(spark.createDataFrame([("a",)], "text string"), "text", "guess")
