import pytest
from pyspark.sql import functions as F

from lodestone.api import Workspace
from lodestone.functions import hashing, policy, stem
from lodestone.functions import text as tx
from lodestone.operators import answers, incremental, relational, search, select
from lodestone.operators.answers import Request


def test_stemmer():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "controlling": "control", "generalizations": "gener", "rate": "rate", "adjustment": "adjust", "agreed": "agre", "sky": "sky"}
    assert {w: stem.stem(w) for w in pairs} == pairs


def test_secrets_are_replaced_at_any_depth(spark):
    import json

    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY-----"
    secrets = ["sk-" + "a1" * 15, "ghp_" + "Ab3" * 12, "AKIA" + "Q" * 16, "AIza" + "x" * 35, "xoxb-" + "1" * 20, pem, pem[:50], "xai-" + "k" * 24, "sk_live_" + "z9" * 10, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12]
    nested = json.dumps({"a": [f"x {s} y" for s in secrets], "b": {"c": {"d": secrets}}})
    texts = [*[f"before {s} after" for s in secrets], nested, "password = 'abcdefghijklmnop'", 'api_key: "your_api_key_here"', '{"client-secret": "abcdefghijklmnop"}', "Authorization: Bearer " + "t" * 30, "sk-short, ghp_x and a password = short", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["t"] for r in df.select("i", policy.secret_free(F.col("t")).alias("t")).collect()}
    n = len(secrets)
    assert all("[REDACTED]" in got[i] and secrets[i] not in got[i] and got[i].startswith("before ") for i in range(n))
    assert all(got[i].endswith(" after") for i in range(n) if i != 6)
    told = json.loads(got[n])
    assert [x for x in told["b"]["c"]["d"]] == ["[REDACTED]"] * n and len(told["a"]) == n
    assert [got[n + k] for k in range(1, 6)] == ["password = '[REDACTED]'", 'api_key: "your_api_key_here"', '{"client-secret": "[REDACTED]"}', "Authorization: Bearer [REDACTED]", texts[-2]] and got[n + 6] is None


def test_normal_form_and_accepted_texts(spark):
    texts = ["\ufb01\u200bx", "plain", None, "a\0", "a\n", "  ", "x" * 4001, "\u00e9"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", policy.normalised(F.col("t")).alias("n"), policy.acceptable(F.col("t")).alias("ok"))
    rows = sorted(df.collect())
    assert [r["n"] for r in rows[:3]] == ["fix", "plain", None] and [r["ok"] for r in rows] == [True, True, False, False, True, False, False, True]


def test_digest_is_canonical():
    assert hashing.digest({"b": 1, "a": "é"}) == hashing.digest({"a": "é", "b": 1})
    with pytest.raises(ValueError):
        hashing.digest(float("nan"))


def test_scalars(spark):
    r = spark.range(1).select(
        tx.retry_after(F.lit("0")).alias("a"), tx.retry_after(F.lit("soon")).alias("b"), tx.pointer_escape(F.lit("a/b~c")).alias("c"), tx.base64url(F.lit("YWI_")).alias("d"),
        tx.cue_seconds(F.lit("01:02:03.500")).alias("e"), hashing.name_uuid(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), F.lit("x")).alias("f"), tx.git_blob(F.lit("hello\n")).alias("g"), search.stemmed(F.lit("running")).alias("h"), policy.case_folded(F.lit("Straße")).alias("i"),
    ).first()
    assert (r["a"], r["b"], r["c"], bytes(r["d"]), r["e"], r["g"], r["h"], r["i"]) == (1, 60, "a~1b~0c", b"ab?", 3723.5, "ce013625030ba8dba906f756967f9e9ca394464a", "run", "strasse")
    assert len(r["f"]) == 36


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "c", 7)], "id int, v string, token int")
    new = spark.createDataFrame([(2, "B", 7), (4, "d", 6), (3, "x", 6)], "id int, v string, token int")

    def ids(df):
        return sorted(map(tuple, df.select("id", "v").collect()))

    assert ids(incremental.newer_wins(old, new, ["id"])) == [(1, "a"), (2, "B"), (3, "x"), (4, "d")]
    assert ids(incremental.insert_missing(old, new, ["id"])) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert ids(incremental.fenced_update(old, new, "id", "token")) == [(1, "a"), (2, "B"), (3, "c")]
    assert ids(incremental.update_where(old, F.col("id") > 2, v=F.lit("z"))) == [(1, "a"), (2, "b"), (3, "z")]
    assert ids(incremental.replace_group(old, new, "id")) == [(1, "a"), (2, "B"), (3, "x"), (4, "d")]
    leased = old.withColumn("removed_at", F.lit(None).cast("timestamp")).withColumn("access_expires_at", F.lit("2024-01-01").cast("timestamp"))
    assert incremental.tombstoned(leased, new, ["id"], "2024-01-02").filter("removed_at IS NOT NULL").count() == 2
    assert incremental.expired(incremental.renewed(leased, new, ["id"], "2025-01-01"), "2024-06-01", "access_expires_at").count() == 1
    owned = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("a", "h2")], "owner string, h string")
    with pytest.raises(ValueError):
        incremental.reassign(owned, "owner", "a", "b", "h")
    assert incremental.reassign(owned, "owner", "a", "c", "h").filter("owner = 'c'").count() == 2


def test_closure_with_cycles_and_holes(spark):
    edges = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 50)] + [("p", "q"), ("q", "p"), ("lost", "nowhere")], "child string, parent string")
    got = dict(map(tuple, relational.descendants(edges, spark.createDataFrame([("0",)], "node string"), most_rounds=8).collect()))
    assert got == {str(i): i for i in range(50)}


def test_greedy_budget_skips(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 90), (1, 2, 4), (1, 3, 3)], "k int, o int, cost int")
    assert select.greedy_budget(rows, "k", "o", 10, 6).first()["chosen"] == [0, 2]


def test_quotes_without_a_join(spark):
    docs = spark.createDataFrame([(1, "abc def ghi"), (2, "xdefx"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, "def"), (11, "abc d"), (12, "def"), (13, None), (14, "")], "item_id long, text string")
    got = sorted(map(tuple, search.quotes(docs, items, block_bytes=4).collect()))
    assert got == [(10, 1), (10, 2), (11, 1), (12, 1), (12, 2), (14, 1), (14, 2)]


@pytest.fixture(scope="module")
def workspace(spark):
    w = Workspace(spark)
    w.register(spark.createDataFrame([
        ("s1", "p", "markdown", "# Limits\n\nThe timeout is 30 seconds. It had 3 failures.\n\n# Other\n\nUnrelated words.", True),
        ("s2", "p", "text", "It had 3 failures.\n\nIt had 7 failures.", True), ("s3", "other", "text", "It had 3 failures in another project.", True), ("s4", "p", "json", "{broken", True), ("s5", "p", "text", "The change was not approved.", False),
    ], "id string, project string, modality string, text string, is_active boolean"))
    w.index()
    return w


def test_search_is_scoped(workspace):
    hits = workspace.search(Request("which failures", project="p"))
    assert {h["id"] for h in hits} == {"s1", "s2"} and all("failures" in h["content"] for h in hits)
    assert not workspace.search(Request("approved", project="p"))
    assert {h["id"] for h in workspace.search(Request("failures", sources=("s3",)))} == {"s3"}


def test_answer_states(workspace):
    assert workspace.answer(Request("how many failures")).state == "tool_required"
    assert workspace.answer(Request("zebra", project="p")).state == "insufficient"
    found = workspace.answer(Request("timeout seconds", project="p"))
    assert found.state == "evidence_only" and found.tokens > 0
    pid = next(h["passage_id"] for h in found.hits if "timeout" in h["content"])
    assert workspace.answer(Request("timeout seconds", project="p"), [{"passage_id": pid, "quote": "timeout is 30"}]).state == "answered"
    assert workspace.answer(Request("timeout seconds", project="p"), [{"passage_id": pid, "quote": "timeout is 31"}]).state == "generation_unavailable"
    hybrid = workspace.answer(Request("timeout", project="p", retrieval="hybrid"))
    assert hybrid.warnings and hybrid.hits


def test_the_fence_reads_the_tables_again(workspace):
    request = Request("which failures", project="p")
    whole = workspace._open(answers.Viewer("local"))
    assert answers.answer(whole, request, current=lambda: whole).state == "evidence_only"
    lost = answers.answer(whole, request, current=lambda: whole.filter("id <> 's2'"))
    assert lost.state == "insufficient" and not lost.hits and lost.warnings


def test_nearest_rank_equals_sorting(spark):
    import math
    import random

    r = random.Random(3)
    rows = [(k, r.choice([r.gauss(0, 1), float(r.randrange(5))])) for k in (1, 2) for _ in range(3000)] + [(3, 7.0), (4, None)]
    wanted = {"a": 0.5, "b": 0.999, "c": 0.0001}
    got = {x["k"]: (x["a"], x["b"], x["c"]) for x in relational.nearest_rank(spark.createDataFrame(rows, "k int, v double"), "k", "v", wanted).collect()}
    for k in (1, 2, 3):
        mine = sorted(v for i, v in rows if i == k)
        assert got[k] == tuple(mine[max(1, math.ceil(q * len(mine))) - 1] for q in wanted.values())


def test_not_in(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")

    def left(values):
        return sorted(str(r["k"]) for r in relational.not_in(df, spark.createDataFrame([(v,) for v in values], "k int"), "k").collect())

    assert left([1]) == ["2"] and left([1, None]) == [] and left([]) == ["1", "2", "None"]


def test_redundancy_keeps_differing_numbers():
    def hit(i, text):
        return {"passage_id": str(i), "id": str(i), "spans": [], "content": text, "tokens": 5, "ordinal": 0}

    hits = [hit(1, "3 failures"), hit(2, "3  Failures"), hit(3, "7 failures"), hit(4, "not approved"), hit(5, "approved")]
    assert [h["id"] for h in answers.chosen(hits, Request("q"))] == ["1", "3", "4", "5"]
    dated = [hit(1, "3 failures") | {"date": "2024-01-01"}, hit(2, "3 failures") | {"date": "2024-01-02"}, hit(3, "3 failures") | {"date": "2024-01-01"}]
    assert [h["id"] for h in answers.chosen(dated, Request("q"))] == ["1", "2"]


def test_overlapping_spans_are_taken_once():
    def hit(i, start, end):
        return {"passage_id": str(i), "id": "s", "spans": [{"block_id": "b", "start": start, "end": end, "unit": "characters"}], "content": str(i), "tokens": 5, "ordinal": i}

    assert [h["ordinal"] for h in answers.chosen([hit(1, 0, 100), hit(2, 10, 90), hit(3, 50, 150), hit(4, 140, 240), hit(5, 19, 219)], Request("q"))] == [1, 3, 4]
    assert len(answers.chosen([hit(i, 100 * i, 100 * i + 90) for i in range(9)], Request("q", most_passages=4))) == 4
    assert len(answers.chosen([hit(i, 100 * i, 100 * i + 90) for i in range(9)], Request("q", most_tokens=14))) == 2


def test_sources_are_known_by_owner_project_and_content(spark):
    columns = "id string, project string, modality string, text string, is_active boolean"
    w = Workspace(spark)
    first = spark.createDataFrame([("b", "p", "text", "It had 3 failures.", True), ("a", "p", "text", "It had 3 failures.", True), ("c", "q", "text", "It had 3 failures.", True), ("d", "p", "text", None, True), ("e", "p", "text", None, True)], columns)
    assert sorted(r["id"] for r in w.register(first).collect()) == ["a", "c", "d", "e"]  # in each project once, the smallest id; null texts are each their own
    again = spark.createDataFrame([("z", "p", "text", "It had 3 failures.", True), ("y", "r", "text", "It had 3 failures.", True)], columns)
    assert sorted(r["id"] for r in w.register(again).collect()) == ["a", "c", "d", "e", "y"]
    assert sorted(r["id"] for r in w.register(again.withColumn("owner", F.lit("other"))).collect()) == ["a", "c", "d", "e", "y", "y", "z"]
    w.sources = w.sources.filter("text IS NOT NULL")
    w.index()
    for project in ("p", "q", "r"):
        assert len(w.search(Request("failures", project=project))) == 1


def test_only_what_the_viewer_may_read_is_searched(spark):
    rows = [("mine", "me", "parsed", True, None, None), ("ended", "me", "parsed", True, "2020-01-01", None), ("runs", "me", "parsed", True, "2999-01-01", None), ("failed", "me", "failed", True, None, None), ("off", "me", "parsed", False, None, None), ("theirs", "you", "parsed", True, None, None), ("account", "me", "parsed", True, None, "a1"), ("revoked", "me", "parsed", True, None, "a2"), ("expired", "me", "parsed", True, None, "a3"), ("others account", "me", "parsed", True, None, "a4")]
    sources = spark.createDataFrame([(i, "p", "text", f"The failures of {i}.", *rest) for i, *rest in rows], "id string, project string, modality string, text string, owner string, status string, is_active boolean, until string, account string")
    accounts = spark.createDataFrame([("a1", "me", "syncing", "valid"), ("a2", "me", "revoked", "valid"), ("a3", "me", "connected", "expired"), ("a4", "you", "connected", "valid")], "account string, owner string, status string, authentication string")
    w = Workspace(spark, accounts)
    w.register(sources.withColumn("access_expires_at", F.col("until").cast("timestamp")).drop("until"))
    w.index()
    me = answers.Viewer("me")
    assert {h["id"] for h in w.search(Request("failures", most_passages=20), me)} == {"mine", "runs", "account"}
    assert {h["id"] for h in w.search(Request("failures"), answers.Viewer("you"))} == {"theirs"}
    assert not w.search(Request("failures"))
    assert w.answer(Request("failures"), viewer=me).state == "evidence_only"
    w.sources = w.sources.withColumn("access_expires_at", F.lit("2020-01-01").cast("timestamp"))
    assert w.answer(Request("failures"), viewer=me).state == "insufficient"


def test_neighbours_are_asked_for_at_a_hits_edges():
    def hit(content, kind="prose", grp="g", section="s", warnings=(), block="b", tokens=10):
        return {"content": content, "kind": kind, "grp": grp, "section": section, "warnings": list(warnings), "spans": [{"block_id": block}], "tokens": tokens}

    middle = " ".join(["x"] * 30 + ["timeout"] + ["y"] * 30)
    assert not answers.touches_edge(hit(middle), "the timeout") and answers.touches_edge(hit("timeout " + middle), "the timeout")
    assert answers.touches_edge(hit(middle, warnings=["cut"]), "other") and not answers.touches_edge(hit("the of", "table"), "of the") and not answers.touches_edge(hit("the why"), "why the")
    assert answers.touches_edge(hit("", "slack"), "x")
    a = hit("timeout")
    assert answers.fits_beside(a, hit("no word", block="b"), "timeout", []) and not answers.fits_beside(a, hit("no word", block="c"), "timeout", [])
    assert answers.fits_beside(a, hit("a Timeout", block="c"), "timeout", [])
    assert not answers.fits_beside(hit("f", "code"), hit("f", "code", section="other"), "f", [])
    thread = hit("t", "slack", tokens=700)
    assert answers.fits_beside(thread, hit("u", "slack", tokens=400), "q", [thread]) and not answers.fits_beside(thread, hit("u", "slack", tokens=600), "q", [thread])


def test_query_terms_of_every_document(spark, tmp_path):
    import re

    from lodestone.plans import catalogue

    texts = {1: "One two one", 2: " ".join(f"W{i % 50}_x" for i in range(3000)), 3: "no length", 4: "", 5: None}
    rows = [(k, t, None if k == 3 or t is None else len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["terms"] for r in catalogue.QUERIES["query_terms"](spark, f"file://{tmp_path}").collect()}
    assert got == {k: " ".join(list(dict.fromkeys(re.findall(r"[a-z0-9]+(?:_[a-z0-9]+)*", (t or "").lower())))[:32]) for k, t in texts.items()}


def test_neighbours_in_blocks_lose_no_query(spark):
    import random

    from lodestone.operators import vectors

    r = random.Random(5)
    rows = [(i, i % 3, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60 + i, 0, [1.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(99, 0, [0.0] * 4)]  # equal ones and one without length
    e = spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>")
    q = e.filter("vec_id % 5 = 0")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    by = {i: v for i, _, v in rows if i != 99}
    near = {i: sorted(((-round(cosine(v, w), 6), j) for j, w in by.items() if j != i))[:4] for i, v in by.items() if i % 5 == 0}
    for sizes in ({}, {"query_block": 3, "corpus_block": 7}):
        got = vectors.neighbours(q, e, 4, **sizes).collect()
        assert {(x["q"], x["vec_id"]) for x in got} == {(i, j) for i, f in near.items() for _, j in f}
        far = {(x["q"], x["vec_id"]) for x in vectors.within(q, e, 0.5, **sizes).collect()}
        assert {p for p in far if abs(cosine(by[p[0]], by[p[1]]) - 0.5) > 1e-6} == {(i, j) for i in near for j in by if i != j and cosine(by[i], by[j]) > 0.5 + 1e-6}
    index = vectors.InvertedLists(e.filter("vec_id <> 99"), lists=8, split=5)
    all_ = index.neighbours(q, 4, probes=8).collect()  # all lists: the exact answer
    assert {(x["q"], x["vec_id"]) for x in all_} == {(i, j) for i, f in near.items() for _, j in f}
    some = {(x["q"], x["vec_id"]) for x in index.neighbours(q, 4, probes=index.probes_for(4, target=0.99)).collect()}
    assert len(some & {(i, j) for i, f in near.items() for _, j in f}) >= 0.9 * 4 * len(near)


def test_the_workspace_keeps_its_index_up_to_date(spark):
    columns = "id string, project string, modality string, text string, is_active boolean"

    def found(question):
        return [h["id"] for h in answers.retrieve(w._open(answers.Viewer("local")), Request(question), index=w.lexical)[0]]

    w = Workspace(spark)
    w.register(spark.createDataFrame([("a", "p", "text", "The pumps were running.", True), ("b", "p", "text", "A pump, and another pump and pump.", True)], columns))
    w.index()
    assert found("pump") == ["b", "a"]  # stems match; the word itself and more of it comes first
    assert found("run") == ["a"] and not found("p")  # what only the labels match isn't evidence
    w.register(spark.createDataFrame([("c", "p", "text", "pump pump pump pump pump pump", True)], columns))
    w.index()
    assert found("pump") == ["c", "b", "a"] and len(w.lexical.segments) == 2
    w.set_active("b", False)
    assert found("pump") == ["c", "a"]
    w.index()
    assert found("pump") == ["c", "a"]
    w.remove_index("c")
    assert found("pump") == ["a"]
    w.lexical = w.lexical.merge()
    assert found("pump") == ["a"] and len(w.lexical.segments) == 1


def test_quotes_by_grams_and_by_automata(spark):
    import random

    from lodestone.operators import search

    r = random.Random(6)
    words = "the of a house river, stone. é\nline x-y  two".split(" ")
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(30)))) for i in range(40)] + [(50, None), (51, "")]
    quotes = [(i, t[a : a + n]) for i, (t, a, n) in enumerate((r.choice(docs[:40])[1], r.randrange(20), r.choice([0, 3, 9, 30, 60])) for _ in range(60))] + [(90, None), (91, "not to be found anywhere at all"), (92, "")]
    got = search.quotes(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, text string"), block_bytes=50)
    assert sorted(map(tuple, got.collect())) == sorted((i, d) for i, q in quotes if q is not None for d, t in docs if t is not None and q in t)


def test_walks_end_at_roots_orphans_cycles_and_the_bound(spark):
    from lodestone.operators import walks

    edges = spark.createDataFrame([("a", "b"), ("b", "r"), ("c", "d"), ("d", "c"), ("o", "p"), *[(f"k{i}", f"k{i + 1}") for i in range(12)], ("self", "self"), (None, "x")], "child string, parent string")
    starts = spark.createDataFrame([(x,) for x in ("a", "c", "o", "k0", "k9", "r", "self", "alone", None)], "node string")
    roots = spark.createDataFrame([("r",), ("k12",)], "node string")
    got = {r["start"]: (r["node"], r["depth"], r["ended"]) for r in walks.ancestors(edges, starts, roots, 8).collect()}
    assert got == {"a": ("r", 2, "root"), "c": ("c", 2, "cycle"), "o": ("p", 1, "orphan"), "k0": ("k8", 8, "bound"), "k9": ("k12", 3, "root"), "r": ("r", 0, "root"), "self": ("self", 1, "cycle"), "alone": ("alone", 0, "orphan")}
    up = {r["start"]: (r["visited"], r["found"]) for r in walks.search_upwards(edges, starts, roots, most_nodes=3, most_depth=8).collect()}
    assert up["a"] == (3, True) and up["k0"] == (3, False) and up["c"] == (2, False) and up["k9"] == (3, False)


def test_json_is_read_as_it_is_written(spark):
    import json

    from lodestone.operators import walks

    deep = "[" * 40 + "1" + "]" * 40
    texts = ['{"a":{"b":[1,{"c/d~":null}]},"e":[],"f":{}}', '{"a":1,"a":2}', "nope", None, '{"x":' + "9" * 39 + "}", '{"x":"1e5 ' + "9" * 50 + '"}', "1e3", deep, '"s"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    assert [r["s"] for r in df.select("i", walks.json_state("j").alias("s")).orderBy("i").collect()] == ["exact", "malformed", "malformed", "missing", "inexact", "exact", "inexact", "exact", "exact"]
    rows = walks.json_nodes(df, "i", "j", deepest=30).collect()
    first = {r["path"]: r["leaf"] for r in rows if r["i"] == 0}
    assert first == {"": None, "/a": None, "/a/b": None, "/a/b/0": "1", "/a/b/1": None, "/a/b/1/c~1d~0": "null", "/e": "[]", "/f": "{}"}
    last = max((r for r in rows if r["i"] == 7), key=lambda r: r["depth"])
    assert last["depth"] == 30 and json.loads(last["leaf"]) is not None
    assert {r["i"] for r in rows} == {0, 4, 5, 6, 7, 8}


def test_quarantine_fails_closed(spark):
    from lodestone.operators import canonical

    rows = spark.createDataFrame([("good", "x", "h1"), ("empty", "", "h2"), ("null", None, "h3"), ("stale", "x", "old"), ("unknown", "x", "h5"), ("half", "x", "h6"), ("half", "", "h6")], "id string, text string, fingerprint string")
    now = spark.createDataFrame([("good", "h1"), ("empty", "h2"), ("null", "h3"), ("stale", "new"), ("half", "h6")], "id string, fingerprint string")
    served, kept = canonical.served(rows, "id", {"text": F.col("text") != ""}, now)
    assert [r["id"] for r in served.collect()] == ["good"]
    assert {r["id"]: r["broken"] for r in kept.collect()} == {"empty": ["text"], "null": ["text"], "stale": ["stale_fingerprint"], "unknown": ["stale_fingerprint"], "half": ["text"]}


def test_each_planted_violation_is_found(spark):
    from lodestone.operators import canonical
    from lodestone.sources import blocks

    made = blocks.parsed(spark.createDataFrame([(i, "markdown", "# H\n\nSome text.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = 1\n```\n") for i in ("ok", "hash", "blank", "twice", "gap", "ragged", "bare", "loose")], "id string, modality string, text string"))
    rel = canonical.relations(made)
    assert canonical.violations(made, rel).count() == 0
    i, t = F.col("id"), F.col("type")
    broken = made.withColumn("content_hash", F.when((i == "hash") & (t == "paragraph"), "0").otherwise(F.col("content_hash")))
    broken = broken.withColumn("content", F.when((i == "blank") & (t == "paragraph"), " ").otherwise(F.col("content")))
    broken = broken.withColumn("block_id", F.when((i == "twice"), "same").otherwise(F.col("block_id")))
    broken = broken.filter(~((i == "gap") & (F.col("ordinal") == 1)))
    broken = broken.withColumn("structured", F.when((i == "ragged") & (t == "table"), '{"headers":["a","b"],"rows":[["1"]]}').when((i == "bare") & (t == "code"), "{}").otherwise(F.col("structured")))
    loose = rel.withColumn("target", F.when(i == "loose", "nowhere").otherwise(F.col("target")))
    got = {}
    for r in canonical.violations(broken, loose).collect():
        got.setdefault(r["id"], set()).add(r["rule"])
    assert "ok" not in got and got["hash"] == {"content_hash"} and "content_is_text" in got["blank"] and "unique_block_id" in got["twice"] and "ordinals_without_gaps" in got["gap"]
    assert "rectangular_table" in got["ragged"] and "code_has_language" in got["bare"] and got["loose"] == {"relation_resolves"}


def test_quotes_in_a_long_text_split_it_once(spark):
    """Grams of one long text take time in proportion to its words, not to their square."""
    import time

    words = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, words), (2, "w1 w2 w3")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(59_980, 60_000))), (8, "w5 w7 w6 w8 w9")], "item_id long, text string")
    began = time.time()
    assert [tuple(r) for r in search.quotes(docs, items).collect()] == [(7, 1)]
    assert time.time() - began < 40


def test_search_upwards_carries_no_paths(spark, monkeypatch):
    """Levels of distinct places, not walks: two nodes joined by 2 ** 6 walks are met once; what has its most_nodes goes no farther."""
    from lodestone.operators import walks

    monkeypatch.delattr(walks, "_walk")
    ladder = [(f"{x}{i}", f"{y}{i + 1}") for i in range(6) for x in "ab" for y in "ab"] + [("b6", "a0"), ("a3", None)]
    edges, starts = spark.createDataFrame(ladder, "child string, parent string"), spark.createDataFrame([("a0",), ("b5",), ("z",), (None,)], "node string")
    wanted = spark.createDataFrame([("a6",)], "node string")
    got = {n: {r["start"]: (r["visited"], r["found"]) for r in walks.search_upwards(edges, starts, wanted, most_nodes=n).collect()} for n in (2, 64)}
    assert got == {2: {"a0": (2, False), "b5": (2, True), "z": (1, False)}, 64: {"a0": (13, True), "b5": (13, True), "z": (1, False)}}


def test_only_parents_walk(spark, monkeypatch):
    """Children of one parent share its walk, one step longer, with the same ends."""
    from lodestone.operators import walks

    walked, walk = [], walks._walk

    def counted(edges, starts, most):
        walked.append(starts.filter("node IS NOT NULL").distinct().count())
        return walk(edges, starts, most)

    monkeypatch.setattr(walks, "_walk", counted)
    edges = [(f"leaf{i}", "p") for i in range(50)] + [("p", "q"), ("q", "r"), ("x", "y"), ("y", "x"), ("in", "x"), ("far", "w0")] + [(f"w{i}", f"w{i + 1}") for i in range(5)]
    starts = [(f"leaf{i}",) for i in range(50)] + [("x",), ("in",), ("far",), ("alone",), ("q",), ("w3",), (None,)]
    found = walks.ancestors(spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame(starts, "node string"), spark.createDataFrame([("r",)], "node string"), most=4)
    got = {r["start"]: ("<".join(r["path"]), r["depth"], r["node"], r["ended"]) for r in found.collect()}
    assert walked == [5]  # p, x, w0, q, w3
    assert got == {f"leaf{i}": (f"leaf{i}<p<q<r", 3, "r", "root") for i in range(50)} | {
        "x": ("x<y<x", 2, "x", "cycle"), "in": ("in<x<y<x", 3, "x", "cycle"), "far": ("far<w0<w1<w2<w3", 4, "w3", "bound"), "alone": ("alone", 0, "alone", "orphan"), "q": ("q<r", 1, "r", "root"), "w3": ("w3<w4<w5", 2, "w5", "orphan"),
    }


def test_what_a_task_finds_within_a_distance_is_bounded(spark, monkeypatch):
    """All vectors are near enough: no pair of blocks gives more than a few million rows, and small blocks give all of them."""
    from lodestone.operators import vectors

    asked, pairs = [], vectors.block_pairs
    monkeypatch.setattr(vectors, "block_pairs", lambda *a, **k: asked.append(k["query_block"] * k["corpus_block"]) or pairs(*a, **k))
    e = spark.createDataFrame([(i, 0, [1.0, i / 100]) for i in range(40)], "vec_id long, label int, embedding array<float>")
    small = vectors.within(e.filter("vec_id % 10 = 0"), e, 0.15, query_block=2, corpus_block=7)
    found = vectors.within(e.filter("vec_id % 10 = 0"), e, 0.15)
    want = sorted((q, v) for q in range(0, 40, 10) for v in range(40) if q != v)
    assert sorted((r["q"], r["vec_id"]) for r in small.collect()) == sorted((r["q"], r["vec_id"]) for r in found.collect()) == want
    assert max(asked) <= 1 << 21
