"""Source code over the driver's tables: masks, brackets, declarations, calls and token streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..code import facts as K
from ..code import lexing as L
from ..operators import graph, intervals
from ..operators import owners as W
from ..session import table


def masked_pages(spark, sf_dir):
    """Each page with what would be comments and strings blank: lengths and lines stay."""
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    m = p.select("page_id", F.length("html").alias("n"), L.masked(F.col("html")).alias("m"))
    return m.select("page_id", F.sha2("m", 256).alias("masked_sha256"), (F.length("m") == F.col("n")).alias("same_length"), F.length(F.regexp_replace("m", r"[ \n]", "")).cast("long").alias("ink"))


def page_brackets(spark, sf_dir):
    """Brackets of each page outside comments and strings: how many are opened and closed, and how far apart partners are."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.lit("text/html").alias("media_type"), F.col("html").alias("text"))
    b = K.bracket_pairs(K.parsed(files))
    return b.groupBy(F.col("file").alias("page_id"), "bracket").agg(F.count("*").alias("opened"), F.count("stop").alias("closed"), F.sum(F.col("stop") - F.col("start")).alias("spans"), F.min("start").alias("first"))


def _sources(spark, sf_dir):
    """A source file for each customer: a class with a method for each order, whose calls go through imports and whose comments and strings hold brackets."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p"))
    call = F.when(F.col("p") == "1", "bus.put('x{')").when(F.col("p") == "2", "tx(a) /* { */").when(F.col("p") == "3", "{ let tx = a; tx(1) }").otherwise("a.b.tx(`{`)")
    method = F.concat(F.lit("  @Timed order"), F.col("o_orderkey").cast("string"), F.lit("(a) {\n    if (a) { "), call, F.lit("; } // {\n  }\n"))
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", method.alias("m"))))
    files = o.groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda r: r["m"]), "").alias("body"))
    head = F.concat(F.lit("import bus, { send as tx } from 'lib/bus';\nclass Customer"), F.col("o_custkey").cast("string"), F.lit(" {\n"))
    return files.select(F.col("o_custkey").alias("file"), F.lit("text/typescript").alias("media_type"), F.concat(head, F.col("body"), F.lit("}\n")).alias("text"))


def code_declarations(spark, sf_dir):
    """Classes and methods of source files made from orders: kind, qualified name, parent and lines."""
    facts = K.parsed(_sources(spark, sf_dir)).where("kind in ('bracket', 'declaration')")
    d = K.declarations(graph.written(facts, f"{graph.work_folder(spark)}/facts"))  # written, or each use would parse again
    return d.select(F.col("file").alias("o_custkey"), "kind", "qualified", "parent", "line", "end_line")


def code_calls(spark, sf_dir):
    """Calls in the innermost declaration of their line, through imports that no local name hides."""
    facts = graph.written(K.parsed(_sources(spark, sf_dir)), f"{graph.work_folder(spark)}/facts")
    calls = K.canonical_calls(facts, {"lib/bus": "bus.default"})
    spans = K.declarations(facts).select("file", F.col("qualified").alias("owner"), F.col("line").alias("start"), F.col("end_line").alias("end"))
    hits = intervals.containing(calls.select("file", F.col("start").alias("at"), "line", "canonical"), spans, ["file"], "line")
    return intervals.innermost(hits, ["file", "at"]).groupBy(F.col("file").alias("o_custkey"), "owner", "canonical").agg(F.count("*").alias("n"), F.min("line").alias("line"))


def owner_roles(spark, sf_dir):
    """Customers as types, whose decorators go by their segment, and orders as their methods: roles of units, or why they have none."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    seg, key = F.col("c_mktsegment"), F.concat(F.lit("t"), F.col("c_custkey").cast("string"))
    types = c.select(F.col("c_custkey").alias("file"), key.alias("declaration_id"), F.when(seg == "BUILDING", "class").otherwise("struct").alias("kind"), key.alias("qualified"), F.lit(None).cast("string").alias("parent_id"), F.when(F.col("c_acctbal") < -800, "recovered").otherwise("exact").alias("quality"))
    method, parent = F.concat(F.lit("m"), F.col("o_orderkey").cast("string")), F.concat(F.lit("t"), F.col("o_custkey").cast("string"))
    symbol = F.concat(parent, F.lit("."), method)
    methods = o.select(F.col("o_custkey").alias("file"), method.alias("declaration_id"), F.lit("method").alias("kind"), symbol.alias("qualified"), parent.alias("parent_id"), F.lit("exact").alias("quality"))
    marks = F.when(seg == "FURNITURE", F.array()).when(seg == "HOUSEHOLD", F.array(F.lit("@Component"), F.lit("@CustomDialog"))).when(seg == "MACHINERY", F.array(F.lit("@Component"), F.lit("@Entry"))).otherwise(F.array(F.lit("@ComponentV2")))
    decorators = c.select(F.col("c_custkey").alias("file"), F.lit("decorator").alias("kind"), F.explode(marks.cast("array<string>")).alias("name"), key.alias("owner_id"), F.lit("exact").alias("quality"))
    times = F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderkey") % 5 == 0, 0).otherwise(1)
    symbols = o.select(F.col("o_custkey").alias("file"), F.lit("symbol").alias("kind"), symbol.alias("name"), method.alias("owner_id"), F.lit("exact").alias("quality"), F.explode(F.array_repeat(F.lit(0), times)).alias("x")).drop("x")
    units = types.select(F.col("declaration_id").alias("unit_id"), "file", F.col("kind").alias("unit_kind"), F.col("declaration_id").alias("owner_id"))
    evidence, diagnostics = W.owner_roles(units, types.unionByName(methods), decorators.unionByName(symbols))
    return evidence.select("unit_id", "symbol", F.col("owner_role").alias("outcome")).unionByName(diagnostics.select("unit_id", F.lit("").alias("symbol"), F.col("code").alias("outcome")))


def lexical_streams(spark, sf_dir):
    """Tokens of each document as code, in both modes, with issues; a cluster is the hash of the shape."""
    d = table(spark, sf_dir, "documents").select("doc_id", L.lexed(F.coalesce("text", F.lit(""))).alias("x"))
    return d.select(
        "doc_id", F.size("x.content").cast("long").alias("n_tokens"), F.sha2(F.array_join("x.content", " "), 256).alias("content_sha256"),
        F.sha2(F.array_join("x.shape", " "), 256).alias("cluster"), F.array_join("x.issues", ",").alias("issues"),
    )


def _quoted(q: str, body: str, stop: str) -> str:
    """RE2 for a literal between ``q``, or to where it can't go on."""
    return rf"{q}(?:[^{q}\\{body}]|\\[\s\S])*(?:{q}|{stop}\\?\z)"


_COMMENT = r"/\*(?:[^*]|\*+[^*/])*(?:\*+/|\**\z)"
_SEGMENT = "|".join([r"//[^\n]*", _COMMENT, *(_quoted(q, "", "") for q in "'\"`"), "[^'\"`/]+", "/"])
_MASKED = rf"""
    p AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), $re${_SEGMENT}$re$) AS s, length(coalesce(html, '')) AS n FROM pages),
    m AS (SELECT page_id, n, coalesce(array_to_string(list_transform(s, lambda x: CASE WHEN regexp_matches(x, $re$^(//|/\*|['"`])$re$) THEN regexp_replace(x, '[^\n]', ' ', 'g') ELSE x END), ''), '') AS m FROM p)"""
_SPACE = r"[\s\pZ\x{0B}\x{1C}-\x{1F}\x{85}]"
_TOKEN = "|".join(
    [_SPACE + "+", r"//[^\n]*\n?", _COMMENT, *(_quoted(q, r"\n\r", r"[\n\r]|") for q in "'\""), _quoted("`", "", ""), r"0[xXbBoO][\pL\pN_]*", r"\p{Nd}[\p{Nd}_]*(?:\.\p{Nd}[\p{Nd}_]*)?(?:[eE][+-]?[\p{Nd}_]+)?n?", r"[\pL_$][\pL\pM\pN_$]*"]
    + ["".join(f"\\{c}" for c in o) for o in sorted(L.OPERATORS, key=lambda o: (-len(o), o))] + [r"[\s\S]"]
)
_WHOLE = "^(?:" + "|".join(rf"{q}(?:[^{q}\\]|\\[\s\S])*{q}" for q in "'\"") + ")$"
_KEYWORDS = ", ".join(f"'{k}'" for k in sorted(L.KEYWORDS))


def lexed_sql(p: str, source: str) -> str:
    """``lexed`` behind the prefix ``p`` (id, c, s): content and shape of the texts of ``source`` (id, text), without the insides of templates."""
    return rf"""
    {p}t AS (SELECT id, list_filter(regexp_extract_all(nfc_normalize(coalesce(text, '')), $re${_TOKEN}$re$), lambda x: NOT regexp_matches(x, $re$^({_SPACE}|//)$re$) AND NOT (x LIKE '/*%*/' AND length(x) > 3)) AS w FROM ({source})),
    {p}u AS (SELECT id, list_transform(w, lambda x: CASE WHEN left(x, 2) = '/*' THEN '<unterminated-comment>'
            WHEN left(x, 1) IN (chr(39), chr(34)) THEN CASE WHEN regexp_matches(x, $re${_WHOLE}$re$) THEN '<string>' ELSE '<unterminated-string>' END
            WHEN left(x, 1) = '`' THEN CASE WHEN length(x) > 1 AND right(x, 1) = '`' THEN '<template>' ELSE '<unterminated-template>' END WHEN regexp_matches(x, $re$^\p{{Nd}}$re$) THEN '<number>' ELSE x END) AS c FROM {p}t),
    {p}lexed AS (SELECT id, c, list_transform(c, lambda x: CASE WHEN regexp_matches(x, $re$^[\pL_$]$re$) AND NOT list_contains([{_KEYWORDS}], x) THEN '<id>' ELSE x END) AS s FROM {p}u)"""


QUERIES = {f.__name__: f for f in (masked_pages, page_brackets, code_declarations, code_calls, owner_roles, lexical_streams)}
ORACLES = {
    "masked_pages": f"WITH {_MASKED} SELECT page_id, sha256(m) AS masked_sha256, length(m) = n AS same_length, CAST(length(regexp_replace(m, '[ \\n]', '', 'g')) AS BIGINT) AS ink FROM m",
    "page_brackets": f"""WITH RECURSIVE {_MASKED},
        k(o, c) AS (VALUES ('{{', '}}'), ('(', ')'), ('[', ']')),
        b AS (SELECT page_id, o AS bracket, i, x = o AS opens FROM (SELECT page_id, i, substr(m, i, 1) AS x FROM (SELECT page_id, m, unnest(range(1, length(m) + 1)) AS i FROM m)) z JOIN k ON x = k.o OR x = k.c),
        n AS (SELECT *, row_number() OVER (PARTITION BY page_id, bracket ORDER BY i) AS n FROM b),
        walk(page_id, bracket, n, stack, start, stop) AS (
            SELECT page_id, bracket, n, CASE WHEN opens THEN [i] ELSE CAST([] AS BIGINT[]) END, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM n WHERE n = 1
            UNION ALL
            SELECT n.page_id, n.bracket, n.n, CASE WHEN n.opens THEN list_append(w.stack, n.i) WHEN len(w.stack) > 0 THEN w.stack[1 : len(w.stack) - 1] ELSE w.stack END,
                   CASE WHEN NOT n.opens AND len(w.stack) > 0 THEN list_last(w.stack) END, CASE WHEN NOT n.opens AND len(w.stack) > 0 THEN n.i END
            FROM walk w JOIN n ON n.page_id = w.page_id AND n.bracket = w.bracket AND n.n = w.n + 1),
        o AS (SELECT page_id, bracket, count(*) AS opened, min(i) - 1 AS first FROM n WHERE opens GROUP BY ALL),
        c AS (SELECT page_id, bracket, count(start) AS closed, sum(stop - start) AS spans FROM walk GROUP BY ALL)
        SELECT o.page_id, o.bracket, o.opened, c.closed, CAST(c.spans AS BIGINT) AS spans, CAST(o.first AS INT) AS first FROM o JOIN c ON c.page_id = o.page_id AND c.bracket = o.bracket""",
    "code_declarations": """
        WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
        SELECT o_custkey, 'method' AS kind, 'Customer' || o_custkey || '.order' || o_orderkey AS qualified, 'Customer' || o_custkey AS parent, CAST(3 * k AS INT) AS line, CAST(3 * k + 2 AS INT) AS end_line FROM o
        UNION ALL SELECT DISTINCT o_custkey, 'class', 'Customer' || o_custkey, NULL, 2, CAST(3 * n + 3 AS INT) FROM o""",
    "code_calls": """
        WITH o AS (SELECT o_custkey, o_orderkey, left(o_orderpriority, 1) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
        SELECT o_custkey, 'Customer' || o_custkey || '.order' || o_orderkey AS owner, CASE p WHEN '1' THEN 'bus.default.put' ELSE 'send' END AS canonical, count(*) AS n, CAST(min(3 * k + 1) AS INT) AS line
        FROM o WHERE p IN ('1', '2') GROUP BY ALL""",
    "owner_roles": """
        WITH c AS (SELECT c_custkey, 't' || c_custkey AS t, c_mktsegment AS seg, CASE WHEN c_acctbal < -800 THEN 'recovered' WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'role_unresolved' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'role_ambiguous' END AS code FROM customer),
        m AS (SELECT t, seg, t || '.m' || o_orderkey AS symbol, CASE WHEN o_orderstatus = 'P' THEN 'symbol_ambiguous' WHEN o_orderkey % 5 = 0 THEN 'symbol_unresolved' END AS code FROM orders JOIN c ON c_custkey = o_custkey WHERE c.code IS NULL)
        SELECT t AS unit_id, '' AS symbol, code AS outcome FROM c WHERE code IS NOT NULL UNION ALL SELECT DISTINCT t, '', code FROM m WHERE code IS NOT NULL
        UNION ALL SELECT t, symbol, 'component' FROM m WHERE code IS NULL UNION ALL SELECT t, symbol, 'page' FROM m WHERE code IS NULL AND seg = 'MACHINERY'""",
    "lexical_streams": f"""
        WITH {lexed_sql("d", "SELECT doc_id AS id, text FROM documents")}
        SELECT id AS doc_id, CAST(len(c) AS BIGINT) AS n_tokens, sha256(coalesce(array_to_string(c, ' '), '')) AS content_sha256, sha256(coalesce(array_to_string(s, ' '), '')) AS cluster,
               concat_ws(',', CASE WHEN list_contains(c, '<unterminated-comment>') THEN 'unterminated_block_comment' END, CASE WHEN list_contains(c, '<unterminated-string>') THEN 'unterminated_string_literal' END,
                         CASE WHEN list_contains(c, '<unterminated-template>') THEN 'unterminated_template_literal' END) AS issues FROM dlexed""",
}
