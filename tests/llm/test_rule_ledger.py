import duckdb
from common import WORD, odd_rows

from chronofold.llm import rule_ledger
from chronofold.llm.queries import ORACLES, op2_rule_ledger


def plain(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measurements_equal_plain_ones(spark):
    texts = ["a b c a b c", "x x x x", "one two\n\none two\n \n#$ & one two", "p q r s p q r", "é 日 \x1c \x85 z\x0bw", "a b a b a", "A!B! C!!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(odd_rows(spark).select("doc_id", "text"))
    for r, t in zip(rule_ledger.measure(rows).collect(), [x["text"] for x in rows.collect()]):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(t)


def test_the_sql_agrees(spark, directory):
    sql = duckdb.connect()
    sql.execute(f"create view documents as select * from '{directory}/documents.parquet'")
    frame = op2_rule_ledger(spark, directory)
    names = frame.columns
    theirs = sql.execute(f"select {', '.join(names)} from ({ORACLES['op2_rule_ledger']})").fetchall()
    assert sorted(tuple(r) for r in frame.collect()) == sorted(theirs)


def test_policies_and_ablations(spark):
    rows = rule_ledger.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    base, full = (rule_ledger.apply_policy(rows, rule_ledger.POLICIES[v]) for v in ("base", "v1"))
    assert base.filter("kept = base_failed").count() == 0
    assert full.filter("kept and base_failed").count() == 0
    found = {r["rule"]: r for r in rule_ledger.ablations(rows, rule_ledger.POLICIES["v1"]).collect()}
    for place, rule in enumerate(rule_ledger.RULES):
        bit = 1 << place
        assert (found[rule]["n_failed"] if rule in found else 0) == rows.filter(f"failed_bits & {bit} <> 0").count()
        assert (found[rule]["n_only_this"] if rule in found else 0) == rows.filter(f"failed_bits = {bit}").count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = full.join(labels, "doc_id").filter("not base_failed")
    assert judged.filter("quality = 1 and not kept").count() <= 0.02 * judged.filter("quality = 1").count()
    rows.unpersist()


def test_no_python_runs_and_empty_tables_stay_empty(spark, directory):
    frame = op2_rule_ledger(spark, directory)
    assert "Python" not in frame._jdf.queryExecution().toString() and "Arrow" not in frame._jdf.queryExecution().toString()
    assert rule_ledger.ledger(odd_rows(spark).limit(0)).count() == 0
