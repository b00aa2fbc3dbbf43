"""Record rules over the driver's tables: projections, policies, orders, budgets, catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as X
from ..operators import graph, retrieval
from ..operators import records as R
from ..session import rows_of, table
from ..sources import readers
from ..sources.store import SnapshotStore, load_projection, publish_projection

_POLICY = [("F", "1-URGENT"), ("F", "2-HIGH"), ("O", "3-MEDIUM"), ("P", "1-URGENT")]
_SHADOWS = [("page", "click", 100, 200), ("page", "signup", 0, 719), ("form", "click", 900, 1000)]
_IMPORTS = [("page", "click", "ui.click"), ("page", "view", "ui.view"), ("page", "signup", "account.signup"), ("form", "click", "forms.click")]
_CUES = [("person", "person"), ("license", "legal"), ("password", "secret")]


def with_signals(spark, sf_dir):
    """Customers with an order; the others have no signals to search by."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"))
    return R.with_signals(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit_id")), "unit_id")


def projected_facts(spark, sf_dir):
    """Suppliers in good standing as facts of their nation, within the span of a unit of its region."""
    s = table(spark, sf_dir, "supplier")
    start = F.floor(F.col("s_acctbal")).cast("long")
    facts = s.select(F.col("s_suppkey").alias("fact_id"), F.col("s_nationkey").alias("owner"), F.when(F.col("s_acctbal") > 0, "exact").otherwise("inferred").alias("quality"), start.alias("start"), (start + 500).alias("end"))
    units = table(spark, sf_dir, "region").select(F.col("r_name").alias("unit_id"), F.col("r_regionkey").alias("root"), F.lit(1000).alias("start"), F.lit(7000).alias("end"))
    return R.projected_facts(facts, units, table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("root"), F.col("n_nationkey").alias("id")))


def export_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    policy = rows_of(spark, _POLICY, "o_orderstatus string, o_orderpriority string")
    return R.export_decisions(o, policy, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "allowed")


def set_mismatch(spark, sf_dir):
    """Nations, segments and hundreds of balance of customers in debt against those of all others."""
    c = table(spark, sf_dir, "customer").withColumn("hundreds", F.floor(F.abs("c_acctbal") / 100))
    return R.set_mismatch(c.where("c_acctbal < 0"), c.where("c_acctbal >= 0 or c_acctbal is null"), ["c_nationkey", "c_mktsegment", "hundreds"])


def normalized_changes(spark, sf_dir):
    """Items as changed files of an order: canonical order with missing paths and lines, and diagnostics."""
    li = table(spark, sf_dir, "lineitem")
    old, new = F.when(F.col("l_returnflag") != "A", F.col("l_shipdate").cast("date").cast("string")), F.when(F.col("l_returnflag") != "R", F.col("l_linestatus"))
    files = li.select("l_orderkey", old.alias("old"), new.alias("new"), F.when(F.col("l_tax") > 0.02, F.col("l_linenumber")).alias("line"), (F.col("l_discount") == 0).alias("is_binary"), "l_partkey", "l_suppkey")
    return R.normalized_changes(files, ["l_orderkey"], "old", "new", "line", "is_binary")


def necessity_order(spark, sf_dir):
    """Orders of a customer as candidates: by necessity, then by key."""
    o = table(spark, sf_dir, "orders").withColumn("necessity", F.when(F.col("o_orderstatus") == "F", "required").when(F.col("o_orderstatus") == "O", "helpful").otherwise("distractor"))
    found = R.ordered(o, ["o_custkey"], [R.role_order(F.col("necessity"), R.NECESSITY).asc(), F.col("o_orderkey").asc()])
    return found.select("o_custkey", "o_orderkey", "necessity", "position")


def role_order(spark, sf_dir):
    """Items of a part as matches: by role, then by supplier, order and line."""
    li = table(spark, sf_dir, "lineitem").withColumn("role", F.when(F.col("l_returnflag") == "N", "owner").when(F.col("l_returnflag") == "R", "member").otherwise("other"))
    li = li.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "role", "l_extendedprice", "l_quantity").dropDuplicates(["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "role"])
    found = R.ordered(li, ["l_partkey"], [R.role_order(F.col("role"), R.ROLES).asc(), *(F.col(c).asc() for c in ("l_suppkey", "l_orderkey", "l_linenumber", "role"))])
    return found.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "role", "position")


def budget_summary(spark, sf_dir):
    """Token estimates of texts by language, and of all."""
    d = table(spark, sf_dir, "documents").select("lang", X.knowledge_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return R.budget_summary(d, ["lang"], "tokens", 2000)


def pooled_ratios(spark, sf_dir):
    """By source and over all: labelled documents that are good, and toxic ones among the bad."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    units = d.select("source", "quality", F.lit(1).alias("one"), (1 - F.col("quality")).alias("bad"), ((1 - F.col("quality")) * F.col("toxic")).alias("bad_toxic"))
    return R.pooled_ratios(units, ["source"], {"coverage": ("quality", "one"), "gap": ("bad_toxic", "bad")})


def regrouped(spark, sf_dir):
    """Orders and suppliers as fragments and atoms, both ways."""
    found = R.regrouped(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber")
    return found.select("direction", "key", F.array_join("members", ",").alias("members"))


def document_catalog(spark, sf_dir):
    """All documents with their labels where they have any, numbered within their source."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return R.catalog(table(spark, sf_dir, "documents").select("doc_id", "source"), labels, "doc_id", ["source"])


def field_scores(spark, sf_dir):
    """Segments' nations as expected and suppliers' nations as found fields, case by case."""
    e = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("e"))
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("a"))
    both = e.join(a, "c_nationkey", "left").fillna(0, ["a"])
    counts = both.select(F.col("c_mktsegment").alias("case"), F.col("c_nationkey").alias("field"), F.least("e", "a").alias("tp"), F.greatest(F.col("a") - F.col("e"), F.lit(0)).alias("fp"), F.greatest(F.col("e") - F.col("a"), F.lit(0)).alias("fn"))
    return R.field_scores(counts, "case", "field")


def bound_calls(spark, sf_dir):
    """Events as calls on a page or form, by the imports of the file and outside of shadowed minutes."""
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_id").alias("call_id"), F.when(F.col("value") > 50, "form").otherwise("page").alias("file"), F.col("event_type").alias("alias"), (F.hour("ts") * 60 + F.minute("ts")).alias("line"))
    return R.bound_calls(calls, rows_of(spark, _IMPORTS, "file string, alias string, canonical string"), rows_of(spark, _SHADOWS, "file string, alias string, start int, end int"))


def change_sides(spark, sf_dir):
    """Customers' finished orders against all others: the largest priority on each side."""
    o = table(spark, sf_dir, "orders").withColumn("done", F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)))
    side = lambda rows: rows.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("v"))
    return R.sides(side(o.where("done")), side(o.where("not done")), ["o_custkey"], "v")


def clause_annotations(spark, sf_dir):
    """Documents with tags from cue words, their length class and their language."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clause_id"), F.lower(F.coalesce("text", F.lit(""))).alias("t"), "lang", "n_chars")
    cues = F.filter(F.array(*(F.when(F.col("t").contains(word), F.lit(tag)) for word, tag in _CUES)), lambda x: x.isNotNull())
    tags = d.select("clause_id", F.lit("tag").alias("kind"), F.explode(cues).alias("value"))
    size = d.where("n_chars > 5000").select("clause_id", F.lit("size").alias("kind"), F.lit("long").alias("value"))
    lang = d.where("lang <> 'en'").select("clause_id", F.lit("lang").alias("kind"), F.col("lang").alias("value"))
    found = R.annotations(d, [tags, size, lang])
    return found.select("clause_id", F.array_join("annotations", ",").alias("annotations"))


def hint_tags(spark, sf_dir):
    """Priorities of a customer's unfinished orders that none of the finished ones has."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit_id"), F.col("o_orderpriority").alias("value"), F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)).alias("done"))
    return retrieval.hint_only(o.where("done").select("unit_id", "value"), o.where("not done").select("unit_id", "value")).distinct()


def evidence_diagnostics(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("has")).distinct(), "c_custkey", "left")
    units = c.select(F.col("c_custkey").alias("unit_id"), (F.col("c_acctbal") < 0).alias("blocked"), (F.col("c_mktsegment") == "BUILDING").alias("unknown"), F.col("has").isNull().alias("empty"), (F.col("c_acctbal") > 9000).alias("over_budget"))
    return retrieval.diagnostics(units).select("unit_id", F.array_join("codes", ",").alias("codes"))


def utc_times(spark, sf_dir):
    """Events' times as text of several zones; only UTC ones are read."""
    e = table(spark, sf_dir, "events")
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(plain, F.when(F.col("event_type") == "view", "Z").when(F.col("event_type") == "click", "+00:00").otherwise("+01:00"))
    return e.select("event_id", F.date_format(X.utc_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def score_conventions(spark, sf_dir):
    """The three conventions for empty denominators side by side, by groups of customers: deep debts against large balances."""
    c = table(spark, sf_dir, "customer").withColumn("part", F.abs(F.floor(F.col("c_acctbal") / 100)) % 97)
    g = c.groupBy("c_nationkey", "c_mktsegment", "part").agg(F.sum((F.col("c_acctbal") < -500).cast("long")).alias("hits"), F.sum((F.col("c_acctbal") > 5000).cast("long")).alias("wrong"))
    h, w = F.coalesce("hits", F.lit(0)), F.coalesce("wrong", F.lit(0))
    return g.select("c_nationkey", "c_mktsegment", "part", F.round(stats.ratio(h, h + w), 6).alias("open"), F.round(stats.ratio_or_zero(h, h + w), 6).alias("zero"), stats.ratio_or_perfect(h, w, F.lit(0), w).alias("perfect"))


def snapshot_by_alias(spark, sf_dir):
    """Parts published twice as one version, then read through the alias that was switched last."""
    store = SnapshotStore(spark, graph.work_folder(spark))
    p = table(spark, sf_dir, "part")
    first = store.publish(p.select("p_partkey", "p_name"))
    second = store.publish(p.select("p_partkey", "p_name", "p_brand").repartition("p_brand"))
    if store.publish(p.select("p_partkey", "p_name", "p_brand")) != second:
        raise AssertionError("equal content has two versions")
    for version in (first, second):
        store.switch_alias("current", version)
    return store.load_alias("current")


def strict_json_records(spark, sf_dir):
    """Customers as JSON, some of it with a repeated, unknown or missing key, or none at all."""
    c = table(spark, sf_dir, "customer")
    key, more = F.concat(F.lit('{"key": '), F.col("c_custkey").cast("string")), F.concat(F.lit(', "nation": '), F.col("c_nationkey").cast("string"))
    segment = F.col("c_mktsegment")
    text = F.when(segment == "BUILDING", F.concat(key, more, F.lit(', "key": 1}'))).when(segment == "HOUSEHOLD", F.concat(key, more, F.lit(', "other": 1}')))
    text = text.when(segment == "MACHINERY", F.concat(key, F.lit("}"))).when(segment == "FURNITURE", F.concat(key, more)).otherwise(F.concat(key, more, F.lit("}")))
    found = readers.strict_records(c.select("c_custkey", text.alias("value")), "key long, nation long")
    return found.select("c_custkey", "problem", F.col("record.key").alias("key"), F.col("record.nation").alias("nation"))


def seed_discovery(spark, sf_dir):
    """Pages' paths as seeds against an inventory of the pages with much HTML; those that fail have a reason."""
    path = F.regexp_extract("url", r"^https?://[^/?#]+/?([^?#]*)", 1)
    p = table(spark, sf_dir, "pages").select(path.alias("path"), F.length("html").alias("n")).where("path <> ''")
    found, problems = readers.discovery(p.select("path").distinct(), p.where("n > 2000").select("path"), ["en/**", "fr/**", "de/*"], ["**/*5"])
    return found.select("path", F.lit("found").alias("reason")).unionByName(problems)


def hunk_texts(spark, sf_dir):
    """Lines and quantities as start:count texts; others give nulls."""
    li = table(spark, sf_dir, "lineitem")
    text = F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "R", "-").otherwise(":"), F.col("l_quantity").cast("int").cast("string"))
    return readers.hunks(li.select("l_orderkey", "l_linenumber", text.alias("hunk")))


def sample_selection(spark, sf_dir):
    """Suppliers of a nation as samples of a category."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").cast("string").alias("category"))
    return readers.select_samples(s, category="3")


def case_observation(spark, sf_dir):
    """Truth cases (orders) observed live: found, what was seen, and whether it agrees."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    truth = o.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("value"))
    seen = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linestatus").alias("value"))
    return R.observed(truth, seen, "case_id").select("case_id", "found", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


def review_excerpts(spark, sf_dir):
    """Turns of the assistant with the turn before and after them, as one text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line"), F.coalesce("text", F.lit("")).alias("text"), "role")
    clauses = c.where("role = 'assistant'").select("conv_id", F.concat_ws(":", "conv_id", "line").alias("clause_id"), F.col("line").alias("start"), F.col("line").alias("end"))
    found = R.excerpts(c.select("conv_id", "line", "text"), clauses, ["conv_id"], 1, 1)
    return found.select("clause_id", "start", "end", F.sha2("excerpt", 256).alias("excerpt_sha256"))


def sealed_projection(spark, sf_dir):
    """Suppliers bound to nations where they are in credit, the others left out on purpose; published in two phases and read back."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("atom_id"), F.col("s_nationkey").cast("string").alias("binding_id"), "s_acctbal")
    bound = s.where("s_acctbal >= 0").select("binding_id", "atom_id")
    store = SnapshotStore(spark, graph.work_folder(spark))
    parts = {"atoms": s.select("atom_id"), "bindings": bound.select("binding_id").distinct(), "binding_atoms": bound, "unclassified": s.where("s_acctbal < 0").select("atom_id")}
    return load_projection(store, publish_projection(store, parts))["binding_atoms"]


def extraction_spans(spark, sf_dir):
    """Items as spans of their orders, extracted by line status, with what is wrong about them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("n_lines"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("end"), "l_linestatus", "l_returnflag")
    anchor = F.concat(F.lit("L"), F.col("l_linenumber").cast("string"), F.lit("-L"), F.col("end").cast("string"))

    def spans(df, wrong):
        return df.select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("start"), "end", F.when(F.col("l_returnflag") == wrong, "L1").otherwise(anchor).alias("anchor"))

    found = R.extracted(li, {"F": lambda df: spans(df, "R"), "O": lambda df: spans(df, "A")}, "l_linestatus")
    return R.span_problems(found, o, ["l_orderkey"])


def rendered_projection(spark, sf_dir):
    """Suppliers of each nation as Markdown, by the state of their account."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    category = F.when(F.col("s_acctbal") < 0, "debt").when(F.col("s_acctbal") < 9000, "credit").otherwise("large")
    entries = s.select(F.col("s_nationkey").alias("n_nationkey"), category.alias("category"), F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("title"))
    return R.rendered(n.select("n_nationkey", F.col("n_name").alias("title")), entries, "n_nationkey", {"large": "Large accounts", "debt": "In debt"})


QUERIES = {
    f.__name__: f
    for f in (
        with_signals, projected_facts, export_decisions, set_mismatch, normalized_changes, necessity_order, role_order, budget_summary, pooled_ratios, regrouped, document_catalog, field_scores, bound_calls, change_sides,
        clause_annotations, hint_tags, evidence_diagnostics, utc_times, score_conventions,
        snapshot_by_alias, strict_json_records, seed_discovery, hunk_texts, sample_selection, case_observation, review_excerpts, sealed_projection, extraction_spans, rendered_projection,
    )
}


def _values(rows):
    return ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)


_PERFECT = "round(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + {0} = 0 THEN 0.0 ELSE tp / (tp + {0})::DOUBLE END, 6)"
_TOKENS = "CAST(greatest(1, ceil(length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) / 4.0) + length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))) AS BIGINT)"

ORACLES = {
    "with_signals": "SELECT c_custkey AS unit_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "projected_facts": """SELECT r_name AS unit_id, s_suppkey AS fact_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE s_acctbal > 0 AND floor(s_acctbal) >= 1000 AND floor(s_acctbal) + 500 <= 7000""",
    "export_decisions": f"SELECT o_orderkey, (o_orderstatus, o_orderpriority) IN ({_values(_POLICY)}) AS allowed FROM orders",
    "set_mismatch": """WITH c AS (SELECT c_nationkey, c_mktsegment, CAST(floor(abs(c_acctbal) / 100) AS BIGINT) AS hundreds, coalesce(c_acctbal < 0, false) AS debt FROM customer),
        a AS (SELECT DISTINCT c_nationkey, c_mktsegment, hundreds FROM c WHERE debt), b AS (SELECT DISTINCT c_nationkey, c_mktsegment, hundreds FROM c WHERE NOT debt)
        SELECT *, 'not_expected' AS problem FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'not_declared' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "normalized_changes": """WITH f AS (SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag <> 'A' THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS old, CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS new,
            CASE WHEN l_tax > 0.02 THEN l_linenumber END AS line, l_discount = 0 AS is_binary, l_partkey, l_suppkey FROM lineitem)
        SELECT *, CASE WHEN is_binary THEN 'binary_file' WHEN old IS NULL AND new IS NULL THEN 'no_path' END AS diagnostic,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(new, ''), coalesce(old, ''), coalesce(line, 0), is_binary NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST) AS position FROM f""",
    "necessity_order": """WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS n FROM orders)
        SELECT o_custkey, o_orderkey, CASE n WHEN 0 THEN 'required' WHEN 1 THEN 'helpful' ELSE 'distractor' END AS necessity, row_number() OVER (PARTITION BY o_custkey ORDER BY n, o_orderkey) AS position FROM o""",
    "role_order": """WITH m AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'owner' WHEN 'R' THEN 'member' ELSE 'other' END AS role FROM lineitem)
        SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE role WHEN 'owner' THEN 0 WHEN 'member' THEN 1 ELSE 3 END, l_suppkey, l_orderkey, l_linenumber, role) AS position FROM m""",
    "budget_summary": f"""WITH d AS (SELECT lang, {_TOKENS} AS n FROM (SELECT lang, coalesce(text, '') AS t FROM documents))
        SELECT lang, count(*) AS n_items, CAST(sum(n) AS BIGINT) AS total_tokens, max(n) AS largest, count(*) FILTER (WHERE n > 2000) AS over_limit FROM d GROUP BY GROUPING SETS ((lang), ())""",
    "pooled_ratios": """SELECT source, sum(quality) / count(*)::DOUBLE AS coverage, CASE WHEN sum(1 - quality) <> 0 THEN sum((1 - quality) * toxic) / sum(1 - quality)::DOUBLE END AS gap
        FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((source), ())""",
    "regrouped": """SELECT 'fragment' AS direction, CAST(l_orderkey AS VARCHAR) AS key, string_agg(m, ',' ORDER BY l_linenumber, m) AS members FROM (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS m FROM lineitem) GROUP BY l_orderkey
        UNION ALL SELECT 'atom', CAST(l_partkey AS VARCHAR), string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY l_partkey""",
    "document_catalog": """SELECT d.doc_id, d.source, l.quality, l.doc_id IS NOT NULL AS carded, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS ordinal
        FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""",
    "field_scores": f"""WITH e AS (SELECT c_mktsegment, c_nationkey, count(*) AS e FROM customer GROUP BY ALL), a AS (SELECT s_nationkey, count(*) AS a FROM supplier GROUP BY ALL),
        b AS (SELECT c_mktsegment AS "case", c_nationkey AS field, e, coalesce(a, 0) AS a FROM e LEFT JOIN a ON c_nationkey = s_nationkey),
        s AS (SELECT "case", field, CAST(sum(least(e, a)) AS BIGINT) AS tp, CAST(sum(greatest(a - e, 0)) AS BIGINT) AS fp, CAST(sum(greatest(e - a, 0)) AS BIGINT) AS fn FROM b GROUP BY GROUPING SETS (("case"), (field), ()))
        SELECT *, {_PERFECT.format("fp")} AS precision, {_PERFECT.format("fn")} AS recall FROM s""",
    "bound_calls": f"""WITH c AS (SELECT event_id, CASE WHEN value > 50 THEN 'form' ELSE 'page' END AS f, event_type AS a, hour(ts) * 60 + minute(ts) AS l FROM events)
        SELECT event_id AS call_id, canonical FROM c JOIN (VALUES {_values(_IMPORTS)}) i(f, a, canonical) ON c.f = i.f AND c.a = i.a
        WHERE NOT EXISTS (SELECT 1 FROM (VALUES {_values(_SHADOWS)}) s(f, a, b, e) WHERE s.f = c.f AND s.a = c.a AND c.l BETWEEN s.b AND s.e)""",
    "change_sides": """WITH b AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), h AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' GROUP BY o_custkey)
        SELECT coalesce(b.o_custkey, h.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN h.o_custkey IS NULL THEN 'removed' WHEN b.v IS NOT DISTINCT FROM h.v THEN 'kept' ELSE 'changed' END AS source_role
        FROM b FULL JOIN h ON b.o_custkey = h.o_custkey""",
    "clause_annotations": "WITH d AS (SELECT *, lower(coalesce(text, '')) AS t FROM documents), a AS ("
    + " UNION ALL ".join(f"SELECT doc_id, 'tag:{tag}' AS x FROM d WHERE contains(t, '{word}')" for word, tag in _CUES)
    + """ UNION ALL SELECT doc_id, 'size:long' FROM d WHERE n_chars > 5000 UNION ALL SELECT doc_id, 'lang:' || lang FROM d WHERE lang <> 'en')
        SELECT d.doc_id AS clause_id, coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') AS annotations FROM d LEFT JOIN a ON a.doc_id = d.doc_id GROUP BY d.doc_id""",
    "hint_tags": """SELECT DISTINCT o_custkey AS unit_id, o_orderpriority AS value FROM orders o WHERE o_orderstatus IS DISTINCT FROM 'F'
        AND NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = o.o_custkey AND f.o_orderpriority = o.o_orderpriority AND f.o_orderstatus = 'F')""",
    "evidence_diagnostics": """SELECT c_custkey AS unit_id, concat_ws(',', CASE WHEN c_mktsegment = 'BUILDING' THEN 'applicability_unknown' END, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'no_evidence' END,
        CASE WHEN c_acctbal < 0 THEN 'retrieval_blocked' END, CASE WHEN c_acctbal > 9000 THEN 'token_budget_exhausted' END) AS codes FROM customer""",
    "utc_times": "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS utc FROM events",
    "score_conventions": """WITH n AS (SELECT c_nationkey, c_mktsegment, abs(CAST(floor(c_acctbal / 100) AS BIGINT)) % 97 AS part, count(*) FILTER (WHERE c_acctbal < -500) AS h, count(*) FILTER (WHERE c_acctbal > 5000) AS w FROM customer GROUP BY ALL)
        SELECT c_nationkey, c_mktsegment, part, CASE WHEN h + w > 0 THEN round(h / (h + w)::DOUBLE, 6) END AS open, CASE WHEN h + w > 0 THEN round(h / (h + w)::DOUBLE, 6) ELSE 0 END AS zero, CASE WHEN h + w > 0 THEN round(h / (h + w)::DOUBLE, 6) ELSE 1 END AS perfect FROM n""",
    "snapshot_by_alias": "SELECT p_partkey, p_name, p_brand FROM part",
    "strict_json_records": """WITH c AS (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'duplicate_key' WHEN 'HOUSEHOLD' THEN 'unknown_key' WHEN 'MACHINERY' THEN 'missing_key' WHEN 'FURNITURE' THEN 'not_json' END AS problem FROM customer)
        SELECT c_custkey, problem, CASE WHEN problem IS NULL THEN c_custkey END AS key, CASE WHEN problem IS NULL THEN c_nationkey END AS nation FROM c""",
    "seed_discovery": r"""WITH p AS (SELECT regexp_extract(url, '^https?://[^/?#]+/?([^?#]*)', 1) AS path, length(html) AS n FROM pages), d AS (SELECT DISTINCT path FROM p WHERE path <> '')
        SELECT path, CASE WHEN NOT (regexp_matches(path, '^(en|fr)/.*$') OR regexp_matches(path, '^de/[^/]*$')) OR regexp_matches(path, '^(?:.*/)?[^/]*5$') THEN 'not_allowed' WHEN path NOT IN (SELECT path FROM p WHERE n > 2000) THEN 'missing' ELSE 'found' END AS reason FROM d""",
    "hunk_texts": """WITH h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '-' ELSE ':' END AS k, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_linenumber || k || q AS hunk, CASE WHEN k = ':' THEN l_linenumber END AS start, CASE WHEN k = ':' THEN q END AS count FROM h""",
    "sample_selection": "SELECT s_suppkey AS sample_id, CAST(s_nationkey AS VARCHAR) AS category FROM supplier WHERE s_nationkey = 3 ORDER BY s_suppkey",
    "case_observation": """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS v FROM orders), s AS (SELECT DISTINCT l_orderkey AS id, l_linestatus AS v FROM lineitem)
        SELECT id AS case_id, id IN (SELECT id FROM s) AS found, CASE WHEN (id, v) NOT IN (SELECT (id, v) FROM s) THEN v ELSE '' END AS missing,
               coalesce((SELECT string_agg(s.v, ',' ORDER BY s.v) FROM s WHERE s.id = t.id AND s.v <> t.v), '') AS extra FROM t""",
    "review_excerpts": """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
        SELECT a.conv_id || ':' || a.turn AS clause_id, min(b.turn) AS start, max(b.turn) AS "end", sha256(string_agg(b.text, chr(10) ORDER BY b.turn)) AS excerpt_sha256
        FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn""",
    "sealed_projection": "SELECT CAST(s_nationkey AS VARCHAR) AS binding_id, CAST(s_suppkey AS VARCHAR) AS atom_id FROM supplier WHERE s_acctbal >= 0",
    "extraction_spans": """WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber AS start, CAST(trunc(l_quantity) AS INTEGER) AS "end", (l_linestatus, l_returnflag) IN (('F', 'R'), ('O', 'A')) AS wrong FROM lineitem),
        o AS (SELECT o_orderkey, floor(o_totalprice / 5000) AS n FROM orders)
        SELECT l_orderkey, l_linenumber, start, "end", CASE WHEN wrong THEN 'L1' ELSE 'L' || start || '-L' || "end" END AS anchor,
               CASE WHEN n IS NULL THEN 'unknown_document' WHEN start < 1 OR start > "end" THEN 'no_lines' WHEN "end" > n THEN 'out_of_range' WHEN wrong THEN 'other_anchor' END AS problem FROM x LEFT JOIN o ON l_orderkey = o_orderkey""",
    "rendered_projection": r"""WITH e AS (SELECT s_nationkey AS k, CASE WHEN s_acctbal < 0 THEN 1 WHEN s_acctbal >= 9000 THEN 0 END AS p, s_suppkey, '- ' || regexp_replace(s_name, '([\\`*_\[\]#|])', '\\\1', 'g') AS line FROM supplier),
        c AS (SELECT k, p, chr(10) || '### ' || CASE p WHEN 0 THEN 'Large accounts' ELSE 'In debt' END || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY s_suppkey) || chr(10) AS t FROM e WHERE p IS NOT NULL GROUP BY k, p)
        SELECT n_nationkey, '# ' || regexp_replace(n_name, '([\\`*_\[\]#|])', '\\\1', 'g') || chr(10) || coalesce((SELECT string_agg(t, '' ORDER BY p) FROM c WHERE k = n_nationkey), '') AS markdown FROM nation""",
}
