"""Rule tables of any size against plain containment."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.functions import grams
from logloom.operators import rule_tables, security

CUSTOM = "rule_type string, category string, pattern string, severity string, action string, enabled int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rules_of(n, seed):
    rng = random.Random(seed)
    words = lambda: "".join(rng.choices("abAB éÉ\U0001f600", k=rng.randrange(0, 6)))
    one = lambda: (
        rng.choice(["blacklist", "blacklist", "whitelist", "other"]), rng.choice(["domain", "tool", "path", "keyword", "else", None]), rng.choice([words(), words(), None]),
        rng.choice(["critical", "low", "odd", "clean", None]), rng.choice(["warn", "block", None]), rng.choice([0, 1, 1, 2, None]),
    )
    return [one() for _ in range(n)]


def hits_by_hand(text, rules):
    out = []
    for kind, category, pattern, severity, action, enabled in rules:
        on = enabled == 1 if kind == "whitelist" else enabled not in (0, None)
        if text is not None and on and kind != "other" and category in rule_tables.KINDS and pattern is not None and pattern.translate(LOW) in text.translate(LOW):
            out.append((kind, category, pattern, severity if severity in ("critical", "low") else "medium", action or "warn"))
    return sorted(out)


@pytest.mark.parametrize("group_bytes", [rule_tables.GROUP_BYTES, 300])
def test_hits(spark, group_bytes):
    rng = random.Random(1)
    rules = rules_of(400, 2) + [("blacklist", "keyword", "", "low", "block", 1), ("blacklist", "tool", "Aa", "low", None, 1), ("blacklist", "tool", "Aa", "low", None, 1)]
    texts = [None, "", *("".join(rng.choices("abAB éÉ\U0001f600", k=rng.randrange(12))) for _ in range(200)), "ab" * 40_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    found = rows.select("id", rule_tables.rule_hits(F.col("text"), spark.createDataFrame(rules, CUSTOM), group_bytes=group_bytes).alias("h"))
    assert {r.id: sorted(map(tuple, r.h)) for r in found.collect()} == {k: hits_by_hand(t, rules) for k, t in enumerate(texts)}


def test_no_rules(spark):
    rows = spark.createDataFrame([(1, "curl x"), (2, None)], "id long, text string")
    plain = rule_tables.with_rule_tables(rows, spark.createDataFrame([], "rule_id string, enabled int"), spark.createDataFrame([], CUSTOM))
    assert {r.id: [f.rule_id for f in r.found] for r in plain.collect()} == {1: ["tool.shell.command"], 2: []}


def test_exemptions(spark):
    text = "curl https://ngrok a@b.cd /home/u cat .npmrc"
    builtin = spark.createDataFrame([("network.external_url", 0), ("personal.email", 1), ("no.such_rule", 0)], "rule_id string, enabled int")

    def fired(*rules, **options):
        rows = spark.createDataFrame([(1, text)], "id long, text string")
        found = rule_tables.with_rule_tables(rows, builtin, spark.createDataFrame([(*r, None, None, 1) for r in rules], CUSTOM), **options).first().found
        return {f.rule_id for f in found}

    network, tool, files, infra = "network.suspicious_domain", "tool.shell.command", "file.sensitive_path", "infra.local_path"
    every = fired(("blacklist", "keyword", "nothing like it"))
    assert {network, tool, infra, "personal.email"} <= every and "network.external_url" not in every
    assert fired(("whitelist", "domain", "NGROK")) == every - {network}
    assert fired(("whitelist", "tool", "Curl"), ("blacklist", "tool", "cat")) == every - {tool} | {"custom.blacklist.tool"}
    assert fired(("whitelist", "path", "/HOME")) == every - {infra} - {r for r in every if r.startswith("file.")}
    assert fired(("whitelist", "keyword", "HTTPS"), ("blacklist", "path", "npm")) == {"custom.blacklist.path"}
    assert fired(("blacklist", "path", "npm"), ("blacklist", "tool", "npm"), only="lacklist.p_th") == {"custom.blacklist.path"}


def test_many_rules_in_one_pass(spark):
    """A hundred thousand patterns: one automaton, one Python node in the plan."""
    rules = spark.range(100_000).select(F.lit("blacklist").alias("rule_type"), F.lit("keyword").alias("category"), F.concat(F.lit("Key"), F.col("id"), F.lit(";")).alias("pattern"), F.lit("low").alias("severity"), F.lit(None).cast("string").alias("action"), F.lit(1).alias("enabled"))
    texts = spark.createDataFrame([(k, f"x key{k}; key{99_999 - k}; key{k + 100_000};") for k in range(0, 99_999, 333)], "id long, text string")
    found = texts.select("id", rule_tables.rule_hits(F.col("text"), rules).alias("h"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert all({h.pattern for h in r.h} == {f"Key{r.id};", f"Key{99_999 - r.id};"} for r in found.collect())
    scored = security.scored(rule_tables.with_rule_tables(texts, spark.createDataFrame([], "rule_id string, enabled int"), rules))
    assert {r.findings for r in scored.collect()} == {2}


@pytest.mark.parametrize("most_words", [rule_tables.MOST_WORDS, 1])
def test_hit_rows(spark, monkeypatch, most_words):
    """By the join, also where the filters let everything pass, windows lie across steps, and equal rules repeat."""
    monkeypatch.setattr(rule_tables, "MOST_WORDS", most_words)
    monkeypatch.setattr(rule_tables, "STEP", 64)
    rng = random.Random(3)
    long = "".join(rng.choices("abAB éÉ\U0001f600", k=300))
    own = [("blacklist", "keyword", p, "low", "block", 1) for p in ("", "Aa", "Aa", "aA", long[7:150], long[100:141].swapcase(), "é" * 9, "K")]
    rules = rules_of(300, 4) + own
    texts = [None, "", long, long, "x" + long.translate(LOW) + "y", long[:60], "kK", *("".join(rng.choices("abAB éÉ\U0001f600", k=rng.randrange(40))) for _ in range(150))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {k: [] for k in range(len(texts))}
    for r in rule_tables.hit_rows(rows, F.col("text"), spark.createDataFrame(rules, CUSTOM), "id").collect():
        got[r.id].append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: hits_by_hand(t, rules) for k, t in enumerate(texts)}


def test_equal_rules_are_dealt_out(spark):
    """The rows of one text and one pattern of very many equal rules are made in several tasks."""
    equal = {"aa": 200_000, "bb": rule_tables.EQUAL, "cc": rule_tables.EQUAL + 1, "dd": 1}
    rules = spark.createDataFrame(list(equal.items()), "pattern string, n int").select(F.lit("blacklist").alias("rule_type"), F.lit("keyword").alias("category"), "pattern", F.lit("low").alias("severity"), F.lit("warn").alias("action"), F.lit(1).alias("enabled"), F.explode(F.sequence(F.lit(1), "n")))
    rows = rule_tables.hit_rows(spark.createDataFrame([(1, "AA bb cc dd")], "id long, text string"), F.col("text"), rules, "id")
    assert {r.pattern: r["count"] for r in rows.groupBy("pattern").count().collect()} == equal
    made = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(made) < 0.6 * sum(made)


def test_long_beginnings_are_not_looked_for_everywhere(monkeypatch):
    """Every start is looked at for widths up to COMMON only, and patterns of any length are found."""
    rng, looked = random.Random(8), set()
    first = rule_tables.Sums.first
    monkeypatch.setattr(rule_tables.Sums, "first", lambda self, n, width: looked.add(width) or first(self, n, width))
    text = "".join(rng.choices("abc é", k=900))
    low = [text[k : k + n].encode() for k, n in enumerate([*range(1, 80), 127, 128, 129, 255, 256, 300, 600])] + [b"q" * n for n in range(1, 40)]
    batch, words = pa.RecordBatch.from_arrays([pa.array(low)], ["low"]), 1 << 10
    filters = np.zeros((2, words), np.uint64)
    for b in rule_tables._filter_bits(words)([batch]):
        which, word, mask = (c.to_numpy() for c in b.columns)
        np.bitwise_or.at(filters, (which, word), mask.view(np.uint64))
    texts = [None, "", text, "x" + text.upper(), text[:50]]
    found = rule_tables.Pieces(sorted(set(map(len, low))), filters).of_batch(pa.array(texts)).to_pylist()
    for t, pieces in zip(texts, found):
        there = {p for p in low if t is not None and p in t.translate(LOW).encode()}
        assert there <= set(pieces) and len(pieces) < len(there) + 300
    assert looked == {1, 2, 4, 8, 16}


@pytest.mark.parametrize("seed", range(3))
def test_scored_rule_tables(spark, seed):
    """As scores of the findings that with_rule_tables() keeps."""
    rng = random.Random(seed)
    words = ["curl ", "https://", "/home/", "a@b.cd", "id_rsa", "NGROK", "plain", "é", "AKIA"]
    texts = [None, "", *(" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(60))]
    rules = [(rng.choice(["blacklist", "whitelist"]), rng.choice(rule_tables.KINDS), rng.choice(words) + rng.choice(["", "", "x", " "]), rng.choice(["critical", "info", "odd", "clean", None]), rng.choice(["block", "warn", None]), rng.choice([1, 1, 0])) for _ in range(4 + 6 * seed)]
    rules += [("blacklist", "keyword", "", "info", None, 1)] * seed
    rows = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "id long, text string")
    builtin, custom = spark.createDataFrame([("network.external_url", 0)], "rule_id string, enabled int"), spark.createDataFrame(rules, CUSTOM)
    plain = security.scored(rule_tables.with_rule_tables(rows, builtin, custom))
    joined = rule_tables.scored_rule_tables(rows, builtin, custom)
    assert joined.columns == plain.columns and sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("query", ["custom_rule_hits", "scan_many_rules"])
def test_rules_are_not_broadcast(spark, tmp_path, monkeypatch, query):
    """Rules of many times a group's size: one broadcast, of filters of fixed size."""
    from logloom.plans import lookups

    spark.createDataFrame([(k, f"See CUSTOMER#{k:09d} there") for k in range(1, 40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1, 300_000).selectExpr("id AS c_custkey", "format_string('Customer#%09d', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "no such part")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    rows = lookups.QUERIES[query](spark, str(tmp_path)).collect()
    assert len(sent) == 1 and sent[0][1].nbytes <= 16 * rule_tables.MOST_WORDS
    hits = {k for k in range(1, 40) if k % 7}
    assert {r.doc_id for r in rows} == hits if query == "custom_rule_hits" else {r.id for r in rows if r.findings} >= hits


@pytest.mark.parametrize("step", [grams.STEP, 5])
def test_possible_patterns(monkeypatch, step):
    """Bits of every pattern that is there, in any row and case, and of few others."""
    monkeypatch.setattr(grams, "STEP", step)
    rng, wanted = random.Random(6), security.WANTED
    texts = [None, "", "cur", "xcurl", *("".join(rng.choice([rng.choice(wanted), rng.choice(wanted).upper(), "", "é ", "a", "the "]) for _ in range(rng.randrange(5))) for _ in range(400)), None, "", "ab"]
    found = grams.bits_of(pa.array(["cut off", *texts]).slice(1), grams.table_of(tuple(wanted)))
    sure = sum(1 for t, bits in zip(texts, found) for k, p in enumerate(wanted) if p in (t or "").translate(LOW) and not (int(bits) >> k % grams.BITS) & 1)
    extra = sum(1 for t, bits in zip(texts, found) for k, p in enumerate(wanted) if p not in (t or "").translate(LOW) and (int(bits) >> k % grams.BITS) & 1)
    assert sure == 0 and extra < 0.15 * len(texts) * len(wanted)


def test_rules_with_bits(spark):
    """The same rules fire with bits and without, and each text is passed to Python once."""
    rng = random.Random(7)
    some = [*security.WANTED, "sk-" + "a" * 21, "eyJ" + "a" * 26 + ".b", "a@b.cd", "13912345678", "113912345678", "1391234567890", "pа", "​", "️", "’", "|", "sh;", "é", "AKIA0123456789ab", "-----BEGIN PRIVATE KEY-----"]
    texts = [None, "", *(" ".join(rng.choice([str, str.upper])(x) for x in rng.choices(some, k=rng.randrange(4))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = security.with_findings(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    low = security.lower_ascii(F.col("text"))
    plain = rows.select("id", F.array_compact(F.array(*[F.when(c, r) for r, _, _, c in security.rules(F.col("text"), low)])).alias("fired"))
    assert {r.id: [f.rule_id for f in r.found] for r in found.collect()} == {r.id: r.fired for r in plain.collect()}
    phones = rows.filter(r"text RLIKE '(?<![0-9])1[3-9][0-9]{9}(?![0-9])'").select("id").collect()
    assert {r.id for r in found.filter("exists(found, f -> f.rule_id = 'personal.phone')").collect()} == {r.id for r in phones}
