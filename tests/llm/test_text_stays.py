"""Statistics meet the boilerplate counts without the texts that they were made from."""

import re

from fleetfold.llm import quality_rules


def joined_columns(df) -> list[str]:
    """What the left side of the uppermost join hands on."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    side = plan.children().apply(0).schema()
    return [side.fields()[i].name() for i in range(side.size())] + [side.simpleString()]


def docs(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{line} {i}\ncommon line here", "s", "x") for i in range(30)] + [(90, None, None, "x"), (91, "too short", "s", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _in0 string")


def test_rules_without_the_text_do_not_move_it(spark):
    *names, types = joined_columns(quality_rules.quality_rules(docs(spark)).drop("text", "source"))
    assert "text" not in names and not re.search("[<,]text:", types) and "_in3" in names


def test_cleaning_moves_the_text_once_and_only_of_rows_that_pass(spark):
    clean = quality_rules.clean_documents(docs(spark))
    *names, types = joined_columns(clean)
    assert names.count("text") == 1 and len(re.findall("[<,]text:", types)) == 1
    plan = clean._jdf.queryExecution().optimizedPlan().toString()
    assert "base_failed" in plan.split("Join LeftOuter")[1].split("Generate")[0]
    got = {r.doc_id: (r.text, r["_in0"]) for r in clean.collect()}
    assert set(got) == set(range(30)) and clean.columns == ["doc_id", "text", "source", "_in0"]
    assert all("common line" not in t and x == "x" for t, x in got.values())
