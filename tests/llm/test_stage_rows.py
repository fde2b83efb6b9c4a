"""Rules and mixing: any column names, zero weights, whole budgets, limits that do not depend on size."""

from fleetfold.llm import exact_dedup, mixing, quality_rules, simhash

CLASH = ("removed _text _host _w row kept common n_words text_key left_words at id none ta tb sha _sha _n _id _epoch taken_id epoch").split()
SCHEMA = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[f"own {c}" for c in CLASH]) for r in rows], SCHEMA).repartition(3)


def words(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_columns_of_any_name_pass_every_stage(spark):
    docs = frame(spark, [(i, words(f"t{i}x"), "en", "src0") for i in range(6)] + [(9, words("t1x"), "en", "src0")])
    mix = mixing.Mix(domains={"crawl": 1}, languages={"en": 1}, budget_percent=100, max_epochs=1)
    for stage, left in (
        (quality_rules.clean_documents, 7), (exact_dedup.keep_first, 6), (simhash.keep_one, 6),
        (lambda d: mixing.mixed_documents(d, mix), 7),
    ):
        out = stage(docs)
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) == left
        assert all(r[c] == f"own {c}" for r in rows for c in CLASH)
    judged = quality_rules.quality_rules(docs)
    assert judged.columns == [c for c in docs.columns if c not in quality_rules.MADE] + [c for c in quality_rules.MADE if c != "common"]
    assert {(r.n_words, r._host, r.kept) for r in judged.collect()} == {(60, "own _host", True)}


def test_a_line_limit_does_not_depend_on_the_host(spark):
    notice = words("notice", 30)

    def host(name, n, marked):
        return [(hash((name, i)) % 10 ** 9, words(f"{name}{i}y") + ("\n" + notice if i < marked else ""), "en", name) for i in range(n)]

    rows = host("small", 21, 21) + host("large", 400, 21) + host("few", 30, 20)
    kept = quality_rules.clean_documents(frame(spark, rows)).collect()
    assert len(kept) == len(rows)
    marked = {s: sum("notice0" in r.text for r in kept if r.source == s) for s in ("small", "large", "few")}
    assert marked == {"small": 0, "large": 0, "few": 20}


def quotas(spark, mix, tokens):
    supply = spark.createDataFrame(tokens, "domain string, language string, source string, tokens bigint")
    return {(r.domain, r.language, r.source): r.quota for r in mixing.leaf_budgets(supply, mix).collect()}


def test_the_whole_budget_is_spent_and_zero_leaves_a_source_out(spark):
    tokens = [("crawl", "en", "a", 1000), ("crawl", "en", "b", 1000), ("crawl", "de", "c", 7), ("books", "en", "d", 1001), ("books", "fr", "e", 13)]
    plain = quotas(spark, mixing.Mix(domains={"crawl": 3, "books": 4}, languages={"en": 3}, budget_percent=71, max_epochs=1), tokens)
    assert sum(plain.values()) == 3021 * 71 // 100
    without = mixing.Mix(sources={"a": 0}, languages={"fr": 0}, budget_percent=100, max_epochs=1)
    got = quotas(spark, without, tokens)
    assert got["crawl", "en", "a"] == 0 and got["books", "fr", "e"] == 0
    assert sum(got.values()) == 1000 + 7 + 1001
    assert set(quotas(spark, mixing.Mix(domains={"crawl": 0, "books": 0}), tokens).values()) == {0}
    docs = spark.createDataFrame([(i, "w " * 40, "en", "src0" if i % 2 else "src1") for i in range(40)],
                                 "doc_id bigint, text string, lang string, source string")
    mix = mixing.Mix(domains={"crawl": 0}, budget_percent=100, max_epochs=1)
    assert {r.doc_id % 2 for r in mixing.mixed_documents(docs, mix).collect()} == {0}
