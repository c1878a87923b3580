"""Registered queries: specifications over the driver's tables, and the SQL that checks each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import SpecError
from .plans.mapper import Mapper
from .plans.schema import Schema
from .sources import io

_SPECS: dict[str, tuple] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slots(source: str, slots: dict, target: str = "Out", **more) -> dict:
    return {"class_derivations": {target: {"populated_from": source, "slot_derivations": slots, **more}}}


def _add(name: str, source: str, spec: dict, sql: str, tables: tuple = (), schema=None, prepare=None, target=None, finish=None, **options) -> None:
    """A query: the source table (prepared), mapped by spec with other tables at hand, finished for comparison."""
    _SPECS[name] = (source, spec, tables, schema, prepare, target, finish, options)
    ORACLES[name] = sql


def _run(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, spec, others, schema, prepare, target, finish, options = _SPECS[name]
        given = {t: table(spark, sf_dir, t) for t in (source, *others)}
        if prepare:
            given[source] = prepare(given[source])
        out = Mapper(spec, schema(given) if schema else None, target, **options).transform(given, source)
        return finish(out) if finish else out

    return query


def _e(text: str) -> dict:
    return {"expr": text}


PROFILE = _slots("customer", {
    "id": {"populated_from": "c_custkey"}, "nation": {"populated_from": "nation.n_name"}, "segment": {"populated_from": "c_mktsegment", "value_mappings": {"BUILDING": "B", "HOUSEHOLD": "H"}},
    "order_count": {"populated_from": "orders.o_orderkey", "aggregation_operation": {"operator": "COUNT"}}, "total_spend": {"populated_from": "orders.o_totalprice", "aggregation_operation": {"operator": "SUM"}},
    "status": _e("case( (c_acctbal < 0, 'debtor'), (True, 'ok') )"),
}, "CustomerProfile", joins={"nation": {"source_key": "c_nationkey", "lookup_key": "n_nationkey"}, "orders": {"source_key": "c_custkey", "lookup_key": "o_custkey"}})
_add("customer_profile", "customer", PROFILE, """
SELECT c_custkey AS id, n_name AS nation, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'HOUSEHOLD' THEN 'H' END AS segment, coalesce(n, 0)::BIGINT AS order_count, round(coalesce(tot, 0), 2) AS total_spend,
 CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE 'ok' END AS status
FROM customer LEFT JOIN (SELECT n_nationkey, any_value(n_name) AS n_name FROM nation GROUP BY 1) ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS tot FROM orders GROUP BY 1) ON c_custkey = o_custkey""", ("nation", "orders"), finish=lambda d: d.withColumn("total_spend", F.round("total_spend", 2)))

_add("copy_rename_const", "customer", _slots("customer", {"id": {"populated_from": "c_custkey"}, "c_name": None, "kind": {"value": "customer"}, "src_class": {"populated_from": "_source_class"}, "h": {"populated_from": "c_acctbal", "hide": True}, "absent": None}),
     "SELECT c_custkey AS id, c_name, 'customer' AS kind, 'customer' AS src_class, NULL::VARCHAR AS absent FROM customer")
_add("expr_arith", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "n": {"populated_from": "l_linenumber", "range": "integer"}, "net": _e("l_extendedprice * (1 - l_discount)"), "q": _e("l_orderkey // 7"), "r": _e("l_orderkey % -7"), "neg": _e("-l_linenumber ** 2"), "b": _e("(l_orderkey & 12) | (l_linenumber << 1)")}),
     "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_extendedprice * (1 - l_discount) AS net, floor(l_orderkey / 7)::BIGINT AS q, (l_orderkey - -7 * floor(l_orderkey / -7.0))::BIGINT AS r, (-(l_linenumber * l_linenumber))::BIGINT AS neg, ((l_orderkey & 12) | (l_linenumber::BIGINT << 1))::BIGINT AS b FROM lineitem")
_add("expr_case_bool", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "band": _e("case((p_size < 10, 'small'), (10 <= p_size < 30, 'medium'), (True, 'large'))"), "both": _e("p_size > 20 and p_retailprice > 1000"), "pick": _e("p_size > 40 and p_name or p_brand"), "no": _e("not p_size"), "has": _e("'a' in p_name"), "among": _e("p_size in [1, 2, 3]")}),
     "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, p_size > 20 AND p_retailprice > 1000 AS both, CASE WHEN p_size > 40 AND p_name <> '' THEN p_name ELSE p_brand END AS pick, p_size = 0 AS no, contains(p_name, 'a') AS has, p_size IN (1, 2, 3) AS among FROM part")
_add("expr_string_fns", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "u": _e("upper(p_name)"), "l": _e("lower(p_brand)"), "c": _e("capitalize(p_type)"), "s": _e("slugify(p_type)"), "n": _e("len(p_name)"), "j": _e("p_brand + '/' + str(p_size)"), "f": _e("str(p_size * 1.0)"), "first": _e("p_name[0]"), "isnum": _e("is_numeric(p_name)")}),
     "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_brand) AS l, upper(p_type[1]) || lower(p_type[2:]) AS c, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS s, length(p_name) AS n, p_brand || '/' || p_size AS j, p_size || '.0' AS f, p_name[1] AS first, try_cast(p_name AS DOUBLE) IS NOT NULL AS isnum FROM part")
_add("expr_slot_ref", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "cents": _e("round(o_totalprice * 100)"), "twice": _e("slot('cents') * 2"), "h": {"expr": "slot('twice') + 1", "hide": True}, "last": _e("slot('h') - slot('cents')")}),
     "SELECT o_orderkey AS k, round_even(o_totalprice * 100, 0)::BIGINT AS cents, 2 * round_even(o_totalprice * 100, 0)::BIGINT AS twice, round_even(o_totalprice * 100, 0)::BIGINT + 1 AS last FROM orders")
_add("expr_block_if", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "grade": _e("target = 'low'\nif o_totalprice > 100000:\n    target = 'mid'\nif o_totalprice > 200000:\n    target = 'high'\n"), "unset": _e("x = o_orderkey\n")}),
     "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS grade, NULL::VARCHAR AS unset FROM orders")
_add("null_semantics", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "n": {"populated_from": "l_linenumber", "range": "integer"}, "eq": _e("NULL == missing"), "ne": _e("l_orderkey != NULL"), "plus": _e("l_orderkey + missing"), "zero": _e("l_quantity / (l_linenumber - l_linenumber)"), "lt": _e("l_quantity < missing"), "floor": _e("(l_linenumber - 4) // 2"), "mod": _e("(l_linenumber - 4) % 3"), "mix": _e("'7' == 7")}),
     "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, TRUE AS eq, TRUE AS ne, NULL::VARCHAR AS plus, NULL::DOUBLE AS zero, NULL::BOOLEAN AS lt, floor((l_linenumber - 4) / 2)::BIGINT AS floor, ((l_linenumber - 4) - 3 * floor((l_linenumber - 4) / 3))::BIGINT AS mod, TRUE AS mix FROM lineitem")
_add("missing_values", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "status": {"populated_from": "o_orderstatus", "missing_values": ["P"]}, "cust": {"populated_from": "o_custkey", "missing_values": [1, "2", 3.0]}}),
     "SELECT o_orderkey AS k, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_custkey NOT IN (1, 2, 3) THEN o_custkey END AS cust FROM orders")
_add("value_map", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "code": {"populated_from": "o_orderstatus", "value_mappings": {"F": 1, "O": 2}}}), "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END::BIGINT AS code FROM orders")
_add("expression_map", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "v": {"populated_from": "o_orderstatus", "expression_mappings": {"F": "o_custkey + 1", "O": "o_custkey * 2"}}}), "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN o_custkey + 1 WHEN 'O' THEN o_custkey * 2 END AS v FROM orders")


def _enum_schema(given) -> Schema:
    s = Schema.from_struct({"customer": given["customer"].schema})
    s.classes["customer"]["attributes"]["c_mktsegment"]["range"] = "Segment"
    return Schema({**s.definition, "classes": s.classes, "enums": {"Segment": {"permissible_values": {"BUILDING": {}, "MACHINERY": {}}}}})


_ENUM = {"House": {"populated_from": "BUILDING"}, "Tool": {"sources": ["MACHINERY", "AUTOMOBILE"]}}
_add("enum_map", "customer", {**_slots("customer", {"k": {"populated_from": "c_custkey"}, "seg": {"populated_from": "c_mktsegment"}}), "enum_derivations": {"Segment": {"permissible_value_derivations": _ENUM}}}, "SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'House' WHEN 'MACHINERY' THEN 'Tool' WHEN 'AUTOMOBILE' THEN 'Tool' END AS seg FROM customer", schema=_enum_schema)
_add("enum_mirror", "customer", {**_slots("customer", {"k": {"populated_from": "c_custkey"}, "seg": {"populated_from": "c_mktsegment"}}), "enum_derivations": {"Segment": {"mirror_source": True, "permissible_value_derivations": _ENUM}}}, "SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'House' WHEN 'MACHINERY' THEN 'Tool' WHEN 'AUTOMOBILE' THEN 'Tool' ELSE c_mktsegment END AS seg FROM customer", schema=_enum_schema)
_add("cast_types", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "i": {"populated_from": "p_retailprice", "range": "integer"}, "f": {"populated_from": "p_size", "range": "float"}, "s": {"populated_from": "p_size", "range": "string"}, "b": {"populated_from": "p_size", "range": "boolean"}, "bad": {"populated_from": "p_name", "range": "integer"}, "t": {"populated_from": "p_name", "range": "boolean"}}),
     "SELECT p_partkey AS k, trunc(p_retailprice)::BIGINT AS i, p_size::DOUBLE AS f, p_size::VARCHAR AS s, p_size <> 0 AS b, try_cast(p_name AS BIGINT) AS bad, lower(p_name) IN ('true', 'yes', '1') AS t FROM part")
_PREFIXES = {"ex": "https://example.org/", "n": "https://example.org/nation/"}
_add("curie_expand", "nation", {"prefixes": _PREFIXES, **_slots("nation", {"id": {"expr": "'n:' + str(n_nationkey)", "range": "uri"}, "other": {"expr": "'zz:' + n_name", "range": "uriorcurie"}})}, "SELECT 'https://example.org/nation/' || n_nationkey AS id, 'zz:' || n_name AS other FROM nation")
_add("uri_compress", "pages", {"prefixes": {"w": "https://", "h": "http://"}, **_slots("pages", {"id": {"populated_from": "page_id"}, "c": {"populated_from": "url", "range": "curie"}})}, "SELECT page_id AS id, CASE WHEN starts_with(url, 'https://') THEN 'w:' || url[9:] WHEN starts_with(url, 'http://') THEN 'h:' || url[8:] ELSE url END AS c FROM pages")
_add("offset_baseline", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "n": {"populated_from": "l_linenumber", "range": "integer", "offset": {"offset_value": 30, "offset_field": "l_suppkey"}}, "m": {"populated_from": "l_quantity", "offset": {"offset_value": 2, "offset_field": "l_linenumber", "offset_reverse": True}}}),
     "SELECT l_orderkey AS k, l_linenumber + 30.0 * l_suppkey::DOUBLE AS n, l_quantity - 2.0 * l_linenumber::DOUBLE AS m FROM lineitem")


def _unit(source: str, target: str, **more) -> dict:
    return {"unit_conversion": {"source_unit": source, "target_unit": target, **more}}


_add("unit_affine", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "cm": {"populated_from": "p_size", **_unit("m", "cm")}, "f": {"populated_from": "p_size", **_unit("degC", "degF")}}), "SELECT p_partkey AS k, p_size * 100.0::DOUBLE AS cm, round(p_size::DOUBLE * 1.8 + 32, 6) AS f FROM part", finish=lambda d: d.withColumns({"f": F.round("f", 6), "cm": F.round("cm", 6)}))
_add("unit_ratio", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "n": {"populated_from": "l_linenumber", "range": "integer"}, "v": {"populated_from": "l_quantity", **_unit("m/s", "km/h")}}), "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, round(l_quantity * 3.6, 6) AS v FROM lineitem", finish=lambda d: d.withColumn("v", F.round("v", 6)))
_add("unit_bridge", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "n": {"populated_from": "l_linenumber", "range": "integer"}, "v": {"populated_from": "l_quantity", **_unit("mg/dL", "mmol/L", molecular_weight=180.0)}}), "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, round(l_quantity * 10 / 180, 6) AS v FROM lineitem", finish=lambda d: d.withColumn("v", F.round("v", 6)))
_NATION = {"nation": {"source_key": "c_nationkey", "lookup_key": "n_nationkey"}}
_add("lookup_join_named", "customer", _slots("customer", {"k": {"populated_from": "c_custkey"}, "n": {"populated_from": "nation.n_name"}, "label": _e("{nation.n_name} + ':' + str(nation.n_regionkey)")}, joins=_NATION), "SELECT c_custkey AS k, n_name AS n, n_name || ':' || n_regionkey AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", ("nation",))
_add("lookup_join_implicit", "labels", _slots("labels", {"id": {"populated_from": "doc_id"}, "lang": {"populated_from": "documents.lang"}, "good": _e("quality == 1 and {documents.n_chars} > 500")}), "SELECT l.doc_id AS id, lang, quality = 1 AND n_chars > 500 AS good FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id", ("documents",))
_add("lookup_miss_null", "customer", _slots("customer", {"k": {"populated_from": "c_custkey"}, "s": {"populated_from": "supplier.s_name"}, "x": _e("{supplier.s_acctbal} + 1")}, joins={"supplier": {"source_key": "c_custkey", "lookup_key": "s_suppkey"}}), "SELECT c_custkey AS k, s_name AS s, s_acctbal + 1 AS x FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey", ("supplier",))
_LINES = {"lineitem": {"source_key": "o_orderkey", "lookup_key": "l_orderkey"}}


def _over(column: str, operator: str, **more) -> dict:
    return {"populated_from": f"lineitem.{column}", "aggregation_operation": {"operator": operator, **more}}


_rounded = lambda *names: lambda d: d.withColumns({n: F.round(n, 7) for n in names})
_add("agg_sum_count_avg", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "s": _over("l_quantity", "SUM"), "c": _over("l_quantity", "COUNT"), "a": _over("l_extendedprice", "AVERAGE")}, joins=_LINES),
     "SELECT o_orderkey AS k, round(coalesce(s, 0), 7) AS s, coalesce(c, 0)::BIGINT AS c, round(a, 7) AS a FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS s, count(*) AS c, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey", ("lineitem",), finish=_rounded("s", "a"))
_add("agg_min_max_median", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "lo": _over("l_extendedprice", "MIN"), "hi": _over("l_extendedprice", "MAX"), "md": _over("l_extendedprice", "MEDIAN")}, joins=_LINES),
     "SELECT o_orderkey AS k, lo, hi, round(md, 7) AS md FROM orders LEFT JOIN (SELECT l_orderkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, median(l_extendedprice) AS md FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey", ("lineitem",), finish=_rounded("md"))
_add("agg_var_pop", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "v": _over("l_quantity", "VARIANCE"), "d": _over("l_quantity", "STD_DEV")}, joins=_LINES),
     "SELECT o_orderkey AS k, round(v, 7) AS v, round(d, 7) AS d FROM orders LEFT JOIN (SELECT l_orderkey, var_pop(l_quantity) AS v, stddev_pop(l_quantity) AS d FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey", ("lineitem",), finish=_rounded("v", "d"))
_add("agg_set_size", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "flags": _over("l_returnflag", "SET"), "all": _over("l_linenumber", "LIST")}, joins=_LINES),
     "SELECT o_orderkey AS k, coalesce(f, '') AS flags, coalesce(n, 0)::BIGINT AS n_all FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS f, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey", ("lineitem",), finish=lambda d: d.select("k", F.array_join(F.sort_array("flags"), ",").alias("flags"), F.size("all").cast("long").alias("n_all")))
_add("agg_mode", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "m": _over("l_returnflag", "MODE")}, joins=_LINES),
     "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(rowid) AS p FROM (SELECT *, row_number() OVER () AS rowid FROM lineitem) GROUP BY 1, 2), m AS (SELECT l_orderkey, arg_max(l_returnflag, struct_pack(n := n, p := p)) AS m FROM c GROUP BY 1) SELECT o_orderkey AS k, m FROM orders LEFT JOIN m ON o_orderkey = l_orderkey", ("lineitem",))
_add("nested_object", "customer", _slots("customer", {"k": {"populated_from": "c_custkey"}, "place": {"class_derivations": {"Place": {"slot_derivations": {"key": {"populated_from": "c_nationkey", "range": "integer"}, "seg": {"populated_from": "c_mktsegment"}}}}}}), "SELECT c_custkey AS k, c_nationkey::BIGINT AS key, c_mktsegment AS seg FROM customer", finish=lambda d: d.select("k", "place.key", "place.seg"))
_add("nested_list_target", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "facts": {"class_derivations": [{"name": "A", "slot_derivations": {"n": {"value": "brand"}, "v": {"populated_from": "p_brand"}}}, {"name": "B", "slot_derivations": {"n": {"value": "type"}, "v": {"populated_from": "p_type"}}}]}}),
     "SELECT p_partkey AS k, 'brand' AS n, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part", finish=lambda d: d.select("k", F.explode("facts").alias("f")).select("k", "f.*"))
_add("nested_join_miss", "customer", _slots("customer", {"k": {"populated_from": "c_custkey"}, "agent": {"class_derivations": {"Agent": {"populated_from": "supplier", "slot_derivations": {"name": {"populated_from": "s_name"}, "of": {"populated_from": "c_name"}}}}}}, joins={"supplier": {"source_key": "c_custkey", "lookup_key": "s_suppkey"}}),
     "SELECT c_custkey AS k, s_name IS NOT NULL AS has, s_name AS name, CASE WHEN s_name IS NOT NULL THEN c_name END AS of FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey", ("supplier",), finish=lambda d: d.select("k", F.col("agent").isNotNull().alias("has"), "agent.name", "agent.of"))


def _turns(d: DataFrame) -> DataFrame:
    return d.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))


def _turn_schema(given) -> Schema:
    return Schema.from_struct({"conversations": given["conversations"].schema})


_TURN = {"conversations_turns": {"populated_from": "conversations_turns", "slot_derivations": {"turn": None, "role": None}}}


def _with_turn(slots: dict) -> dict:
    return {"class_derivations": {"Out": {"populated_from": "conversations", "slot_derivations": slots}, **_TURN}}


_add("list_to_dict", "conversations", _with_turn({"id": {"populated_from": "conv_id"}, "turns": {"populated_from": "turns", "cast_collection_as": "MultiValuedDict", "dictionary_key": "turn"}}), "SELECT conv_id AS id, turn::VARCHAR AS key, role FROM conversations", schema=_turn_schema, prepare=_turns, finish=lambda d: d.select("id", F.explode("turns")).select("id", "key", "value.role"))
_add("stringify_join", "conversations", _slots("conversations", {"id": {"populated_from": "conv_id"}, "roles": {"populated_from": "roles", "stringification": {"delimiter": "|"}}, "json": {"populated_from": "roles", "stringification": {"syntax": "JSON"}}}),
     "SELECT conv_id AS id, string_agg(role, '|' ORDER BY turn) AS roles, '[\"' || string_agg(role, '\", \"' ORDER BY turn) || '\"]' AS json FROM conversations GROUP BY 1", prepare=lambda d: _turns(d).select("conv_id", F.transform("turns", lambda x: x["role"]).alias("roles")))
_add("split_reversed", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "w": {"populated_from": "p_type", "stringification": {"delimiter": " ", "reversed": True}}}), "SELECT p_partkey AS k, unnest(string_split(p_type, ' ')) AS w FROM part", finish=lambda d: d.select("k", F.explode("w").alias("w")))
_add("comprehension", "conversations", _slots("conversations", {"id": {"populated_from": "conv_id"}, "n": _e("len([t for t in turns if t.role == 'user'])"), "last": _e("max([t.turn + 1 for t in turns])"), "roles": _e("turns.role")}),
     "SELECT conv_id AS id, count(*) FILTER (role = 'user') AS n, max(turn) + 1 AS last, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1", prepare=_turns, schema=_turn_schema, finish=lambda d: d.withColumn("roles", F.array_join("roles", ",")))
_add("melt_prices", "part", _slots("part", {}, pivot_operation={"direction": "MELT", "id_slots": ["p_partkey"], "source_slots": ["p_size", "p_retailprice"], "variable_slot": "variable", "value_slot": "value"}), "SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
_add("unmelt_flags", "lineitem", _slots("lineitem", {"A": None, "N": None, "R": None}, pivot_operation={"direction": "UNMELT", "id_slots": ["l_orderkey"], "variable_slot": "flag", "value_slot": "q"}), "SELECT l_orderkey, max(q) FILTER (f = 'A') AS A, max(q) FILTER (f = 'N') AS N, max(q) FILTER (f = 'R') AS R FROM (SELECT l_orderkey, l_returnflag AS f, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1",
     prepare=lambda d: d.groupBy("l_orderkey", F.col("l_returnflag").alias("flag")).agg(F.round(F.sum("l_quantity"), 4).alias("q")))
_add("json_nested_path", "events", _slots("events", {"id": {"populated_from": "event_id"}, "k": {"populated_from": "props.k"}, "x": _e("{props.k} + 1")}), "SELECT event_id AS id, json_extract(props, '$.k')::BIGINT AS k, json_extract(props, '$.k')::BIGINT + 1 AS x FROM events", prepare=lambda d: d.select("event_id", F.from_json("props", "k long").alias("props")))


def lookup_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of lookups: the first mapping's result is a table of the second."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "nation", "region")}
    first = Mapper(_slots("nation", {"key": {"populated_from": "n_nationkey"}, "region": {"populated_from": "region.r_name"}}, joins={"region": {"source_key": "n_regionkey", "lookup_key": "r_regionkey"}})).transform(t, "nation")
    spec = _slots("customer", {"k": {"populated_from": "c_custkey"}, "region": {"populated_from": "place.region"}}, joins={"place": {"source_key": "c_nationkey", "lookup_key": "key"}})
    return Mapper(spec).register_join_table("place", first, "key").transform(t["customer"], "customer")


def stream_stateless_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same projection over a stream of files, run until what is there is done; its result read back as a table."""
    at = _folder(spark)
    events = table(spark, sf_dir, "events")
    spec = _slots("events", {"id": {"populated_from": "event_id"}, "kind": _e("upper(event_type)"), "v": _e("value * 2")})
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    from .streaming.stream import run_available

    run_available(Mapper(spec).transform(stream, "events"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


ORACLES["lookup_two_stage"] = "SELECT c_custkey AS k, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
ORACLES["stream_stateless_map"] = "SELECT event_id AS id, upper(event_type) AS kind, value * 2 AS v FROM events"




# -- single functions and rules ---------------------------------------------------------------------------------------
_add("fn_title", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "t": _e("title(lower(p_type))"), "n": _e("strlen(p_type)")}), "SELECT p_partkey AS k, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS t, length(p_type)::BIGINT AS n FROM part")
_add("fn_int_float", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "n": {"populated_from": "l_linenumber", "range": "integer"}, "i": _e("int(l_extendedprice)"), "s": _e("int(str(l_linenumber)) + 1"), "f": _e("float(str(l_linenumber))"), "d": _e("int(-l_quantity / 7)")}),
     "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, trunc(l_extendedprice)::BIGINT AS i, l_linenumber::BIGINT + 1 AS s, l_linenumber::DOUBLE AS f, trunc(-l_quantity / 7)::BIGINT AS d FROM lineitem")
_add("fn_bool_abs", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "n": {"populated_from": "l_linenumber", "range": "integer"}, "b": _e("bool(l_linenumber - 1)"), "a": _e("abs(l_linenumber - 4)"), "q": _e("is_numeric(str(l_quantity))"), "w": _e("is_numeric(l_returnflag)")}),
     "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_linenumber <> 1 AS b, abs(l_linenumber - 4)::BIGINT AS a, TRUE AS q, FALSE AS w FROM lineitem")
_add("expr_round_digits", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "n": {"populated_from": "l_linenumber", "range": "integer"}, "one": _e("round(l_quantity / 8, 1 + 1)"), "tens": _e("round(l_orderkey / 4, -1)"), "row": _e("round(l_quantity / 8, l_linenumber % 3)")}),
     "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, round_even(l_quantity / 8, 2) AS one, round_even(l_orderkey / 40.0, 0)::DOUBLE * 10 AS tens, round_even(l_quantity / 8, (l_linenumber % 3)::INT) AS row FROM lineitem")
_add("expr_pow", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "n": {"populated_from": "l_linenumber", "range": "integer"}, "sq": _e("l_linenumber ** 2"), "two": _e("2 ** l_linenumber"), "big": _e("3 ** 39 + l_linenumber"), "half": _e("l_linenumber ** -1")}),
     "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, (l_linenumber * l_linenumber)::BIGINT AS sq, pow(2.0, l_linenumber)::DOUBLE AS two, 4052555153018976267 + l_linenumber::BIGINT AS big, 1.0::DOUBLE / l_linenumber AS half FROM lineitem")
_add("expr_bits", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "n": {"populated_from": "l_linenumber", "range": "integer"}, "x": _e("l_orderkey ^ 21"), "i": _e("~l_linenumber"), "r": _e("l_orderkey >> 2"), "p": _e("+l_linenumber"), "not": _e("not l_linenumber > 3")}),
     "SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, xor(l_orderkey, 21) AS x, (-l_linenumber - 1)::BIGINT AS i, l_orderkey >> 2 AS r, l_linenumber::BIGINT AS p, NOT l_linenumber > 3 AS not FROM lineitem")
_add("expr_lists", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "l": _e("[p_size, 1] + [2] * 2"), "last": _e("[p_size, p_size + 5, 3][-1]"), "mid": _e("p_brand[-1]"), "least": _e("min([p_size, 10])"), "up": _e("upper([p_name, p_brand])")}),
     "SELECT p_partkey AS k, p_size || ',1,2,2' AS l, 3::BIGINT AS last, p_brand[-1] AS mid, least(p_size, 10)::BIGINT AS least, upper(p_name) || '|' || upper(p_brand) AS up FROM part", finish=lambda d: d.withColumns({"l": F.array_join("l", ","), "up": F.array_join("up", "|")}))
_add("expr_subscript", "conversations", _slots("conversations", {"id": {"populated_from": "conv_id"}, "first": _e("turns[0].role"), "last": _e("turns[-1].turn")}), "SELECT conv_id AS id, arg_min(role, turn) AS first, max(turn) AS last FROM conversations GROUP BY 1", prepare=_turns, schema=_turn_schema)
_URL = "https://example.org/"
_add("uuid5_key", "customer", _slots("customer", {"k": {"populated_from": "c_custkey"}, "u": _e(f"uuid5('{_URL}', c_name)")}),
     f"SELECT c_custkey AS k, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(instr('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS u FROM (SELECT c_custkey, sha1(unhex('{uuid.uuid5(uuid.NAMESPACE_URL, _URL).hex}') || encode(c_name)) AS h FROM customer)")

# -- shapes -------------------------------------------------------------------------------------------------------------
_add("to_list_single", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "many": {"populated_from": "p_brand", "cast_collection_as": "MultiValued"}, "one": {"populated_from": "names", "cast_collection_as": "SingleValued"}}), "SELECT p_partkey AS k, p_brand AS many, p_name AS one FROM part", prepare=lambda d: d.select("p_partkey", "p_brand", F.array("p_name").alias("names")), finish=lambda d: d.withColumn("many", F.array_join("many", ",")))
_add("dict_to_list", "conversations", {"class_derivations": {"Out": {"populated_from": "conversations", "slot_derivations": {"id": {"populated_from": "conv_id"}, "turns": {"populated_from": "turns", "cast_collection_as": "MultiValuedList", "dictionary_key": "turn"}}}, "conversations_turns": {"populated_from": "conversations_turns", "slot_derivations": {"role": None}}}},
     "SELECT conv_id AS id, turn::VARCHAR AS turn, role FROM conversations", schema=_turn_schema, prepare=lambda d: _turns(d).select("conv_id", F.map_from_entries(F.transform("turns", lambda x: F.struct(x["turn"].cast("string"), F.struct(x["role"].alias("role"))))).alias("turns")), finish=lambda d: d.select("id", F.explode("turns").alias("t")).select("id", "t.turn", "t.role"))
_add("stringify_yaml", "conversations", _slots("conversations", {"id": {"populated_from": "conv_id"}, "yaml": {"populated_from": "roles", "stringification": {"syntax": "YAML"}}}), "SELECT conv_id AS id, '[' || string_agg(role, ', ' ORDER BY turn) || ']' AS yaml FROM conversations GROUP BY 1", prepare=lambda d: _turns(d).select("conv_id", F.transform("turns", lambda x: x["role"]).alias("roles")))
_add("class_recursion", "conversations", {"class_derivations": {"Out": {"populated_from": "conversations", "slot_derivations": {"id": {"populated_from": "conv_id"}, "turns": {"populated_from": "turns"}}}, "Turn": {"populated_from": "conversations_turns", "slot_derivations": {"at": {"populated_from": "turn"}, "who": _e("upper(role)")}}}},
     "SELECT conv_id AS id, turn AS at, upper(role) AS who FROM conversations", schema=_turn_schema, prepare=_turns, finish=lambda d: d.select("id", F.explode("turns").alias("t")).select("id", "t.at", "t.who"))
_marks = lambda d: _turns(d).select("conv_id", F.transform("turns", lambda x: F.when(x["turn"] == 0, "n/a").otherwise(x["turn"].cast("string"))).alias("marks"))
_over_list = lambda operator, **more: {"populated_from": "marks", "aggregation_operation": {"operator": operator, **more}}
_add("agg_invalid_values", "conversations", _slots("conversations", {"id": {"populated_from": "conv_id"}, "skip": _over_list("AVERAGE"), "zero": _over_list("AVERAGE", invalid_value_handling="TREAT_AS_ZERO"), "total": _over_list("SUM", null_handling="IGNORE"), "n": _over_list("COUNT")}),
     "SELECT conv_id AS id, round(avg(CASE WHEN turn <> 0 THEN turn END), 7) AS skip, round(avg(turn), 7) AS zero, sum(turn)::DOUBLE AS total, count(*) AS n FROM conversations GROUP BY 1", prepare=_marks, finish=_rounded("skip", "zero"))
_add("inheritance", "customer", {"class_derivations": {"Base": {"slot_derivations": {"name": {"populated_from": "c_name"}, "level": {"value": "base"}}}, "Named": {"slot_derivations": {"seg": _e("lower(c_mktsegment)")}}, "Out": {"populated_from": "customer", "is_a": "Base", "mixins": ["Named"], "slot_derivations": {"k": {"populated_from": "c_custkey"}, "level": {"value": "own"}}}}},
     "SELECT c_custkey AS k, c_name AS name, 'own' AS level, lower(c_mktsegment) AS seg FROM customer")


def _any_of_schema(given) -> Schema:
    s = Schema.from_struct({"customer": given["customer"].schema})
    s.classes["customer"]["attributes"]["c_mktsegment"] = {"any_of": [{"range": "Home"}, {"range": "Work"}]}
    return Schema({**s.definition, "classes": s.classes, "enums": {"Home": {"permissible_values": {"HOUSEHOLD": {}}}, "Work": {"permissible_values": {"MACHINERY": {}, "BUILDING": {}}}}})


_add("enum_any_of", "customer", {**_slots("customer", {"k": {"populated_from": "c_custkey"}, "seg": {"populated_from": "c_mktsegment"}}), "enum_derivations": {"H": {"populated_from": "Home", "permissible_value_derivations": {"home": {"populated_from": "HOUSEHOLD"}}}, "W": {"populated_from": "Work", "permissible_value_derivations": {"tool": {"populated_from": "MACHINERY"}}}}}, "SELECT c_custkey AS k, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'home' WHEN 'MACHINERY' THEN 'tool' END AS seg FROM customer", schema=_any_of_schema)
_measured = lambda d: d.select("p_partkey", F.struct(F.col("p_size").cast("double").alias("magnitude"), F.when(F.col("p_partkey") % 2 == 0, "m").otherwise("cm").alias("unit")).alias("q"))
_add("unit_structured", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "q": {"populated_from": "q", "unit_conversion": {"target_unit": "mm", "source_unit_slot": "unit", "source_magnitude_slot": "magnitude", "target_magnitude_slot": "size", "target_unit_slot": "in"}}}),
     "SELECT p_partkey AS k, round(p_size * CASE WHEN p_partkey % 2 = 0 THEN 1000.0 ELSE 10.0 END, 6)::DOUBLE AS size, 'mm' AS unit FROM part", prepare=_measured, finish=lambda d: d.select("k", F.round("q.size", 6).alias("size"), F.col("q.in").alias("unit")))
_add("unit_non_numeric", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "v": {"populated_from": "size", **_unit("kg", "g", none_if_non_numeric=True)}, "same": {"populated_from": "size", **_unit("g{dry}", "g", none_if_non_numeric=True)}}),
     "SELECT p_partkey AS k, CASE WHEN p_size % 3 <> 0 THEN p_size * 1000.0 END::DOUBLE AS v, CASE WHEN p_size % 3 <> 0 THEN p_size END::DOUBLE AS same FROM part", prepare=lambda d: d.select("p_partkey", F.when(F.col("p_size") % 3 == 0, "unknown").otherwise(F.col("p_size").cast("string")).alias("size")), finish=lambda d: d.withColumn("v", F.round("v", 6)))
_add("melt_named", "part", _slots("part", {}, pivot_operation={"direction": "MELT", "id_slots": ["p_partkey"], "source_slots": ["p_size"], "variable_slot": "what", "value_slot": "much"}), "SELECT p_partkey, 'p_size' AS what, p_size AS much FROM part")
_add("case_numbers", "orders", _slots("orders", {"k": {"populated_from": "o_orderkey"}, "v": _e("case((o_totalprice > 150000, 1), (o_totalprice > 50000, 2))"), "s": _e("len(str(o_custkey))")}), "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 150000 THEN 1 WHEN o_totalprice > 50000 THEN 2 END::BIGINT AS v, length(o_custkey::VARCHAR) AS s FROM orders")


def reference_in_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between the objects of one container: each mark's nation by its identifier."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation")}
    nations = t["nation"].groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))).alias("nations"), F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("of"))).alias("marks"))
    schema = {"classes": {"Box": {"tree_root": True, "attributes": {"marks": {"range": "Mark", "multivalued": True, "inlined_as_list": True}, "nations": {"range": "Nation", "multivalued": True, "inlined_as_list": True}}}, "Mark": {"attributes": {"of": {"range": "Nation"}}}, "Nation": {"attributes": {"id": {"identifier": True}, "name": {}}}}}
    spec = {"class_derivations": {"Box": {"slot_derivations": {"marks": {"populated_from": "marks"}}}, "Mark": {"slot_derivations": {"id": {"populated_from": "of"}, "name": _e("of.name")}}}}
    return Mapper(spec, schema).transform(nations, "Box").select(F.explode("marks").alias("m")).select("m.id", "m.name")


ORACLES["reference_in_container"] = "SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation"


def _refers(**ranges: tuple[str, str, str]):
    """A schema maker: columns whose values identify rows of a table, as column=(its table, the table, its identifier)."""

    def make(given) -> Schema:
        s = Schema.from_struct({t: d.schema for t, d in given.items()})
        for column, (table_, other, key) in ranges.items():
            s.classes[table_]["attributes"][column]["range"] = other
            s.classes[other]["attributes"][key]["identifier"] = True
        return s

    return make


_add("reference_in_table", "customer", _slots("customer", {"k": {"populated_from": "c_custkey"}, "id": {"populated_from": "c_nationkey"}, "nation": _e("{c_nationkey.n_name}"), "low": _e("lower(c_nationkey.n_name) + str(c_nationkey.n_regionkey)")}),
     "SELECT c_custkey AS k, c_nationkey AS id, n_name AS nation, lower(n_name) || n_regionkey AS low FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", ("nation",), _refers(c_nationkey=("customer", "nation", "n_nationkey")))
_add("reference_list", "lineitem", _slots("lineitem", {"k": {"populated_from": "l_orderkey"}, "names": _e("l_suppkeys.s_name"), "n": _e("len(l_suppkeys)")}),
     "SELECT l_orderkey AS k, string_agg(s_name, '|' ORDER BY l_linenumber, l_suppkey, l_partkey) AS names, count(*) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1", ("supplier",), _refers(l_suppkeys=("lineitem", "supplier", "s_suppkey")),
     prepare=lambda d: d.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))), lambda x: x["l_suppkey"]).alias("l_suppkeys")), finish=lambda d: d.withColumn("names", F.array_join("names", "|")))


def _folded(column: str, operator: str, **more) -> dict:
    return {"populated_from": column, "aggregation_operation": {"operator": operator, **more}}


_add("group_by", "lineitem", _slots("lineitem", {"flag": {"populated_from": "l_returnflag"}, "status": _e("lower(l_linestatus)"), "kind": {"value": "sum"}, "n": _folded("l_quantity", "COUNT"), "q": _folded("l_quantity", "SUM"), "price": _folded("l_extendedprice", "AVERAGE"), "most": _folded("l_extendedprice", "MAX"), "lines": _folded("l_linenumber", "SET")}),
     "SELECT l_returnflag AS flag, lower(l_linestatus) AS status, 'sum' AS kind, count(*) AS n, round(sum(l_quantity), 7) AS q, round(avg(l_extendedprice), 7) AS price, max(l_extendedprice) AS most, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS lines FROM lineitem GROUP BY 1, 2",
     finish=lambda d: _rounded("q", "price")(d).withColumn("lines", F.array_join(F.sort_array(F.transform("lines", lambda x: x.cast("string"))), ",")), grouped=True)
_add("group_by_lookup", "customer", _slots("customer", {"nation": {"populated_from": "nation.n_name"}, "n": _folded("c_custkey", "COUNT"), "region": _folded("nation.n_regionkey", "MIN"), "balance": _folded("c_acctbal", "SUM")}, joins=_NATION),
     "SELECT n_name AS nation, count(*) AS n, min(n_regionkey) AS region, round(sum(c_acctbal), 7) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", ("nation",), finish=_rounded("balance"), grouped=True)
_add("enum_root", "customer", {"class_derivations": {}, "enum_derivations": {"customer": {"permissible_value_derivations": _ENUM, "mirror_source": True}}}, "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'House' WHEN 'MACHINERY' THEN 'Tool' WHEN 'AUTOMOBILE' THEN 'Tool' ELSE c_mktsegment END AS c_mktsegment FROM customer",
     schema=lambda given: Schema({"enums": {"customer": {"permissible_values": {"BUILDING": {}, "MACHINERY": {}}}}}), prepare=lambda d: d.select("c_mktsegment"))
_add("type_root", "nation", {"class_derivations": {}}, "SELECT n_name FROM nation", schema=lambda given: Schema({"types": {"nation": {"typeof": "string"}}}), prepare=lambda d: d.select("n_name"))
_add("ext_text", "part", _slots("part", {"k": {"populated_from": "p_partkey"}, "a": _e("substr(p_type, 1, 4)"), "b": _e("substr(p_type, -3)"), "c": _e("strip('  ' + p_brand + ' ')"), "d": _e("replace(p_type, ' ', '.')"), "e": _e("startswith(p_type, 'S') or endswith(p_type, 'L')"), "f": _e("contains(p_name, 'e')"), "g": _e("join('/', split(p_type))"), "h": _e("to_pascal(to_snake('someNiceName'))"), "i": _e("coalesce(NULL, p_brand)"), "j": _e("to_camel('a_' + lower(p_brand))")}),
     "SELECT p_partkey AS k, substr(p_type, 2, 3) AS a, right(p_type, 3) AS b, p_brand AS c, replace(p_type, ' ', '.') AS d, starts_with(p_type, 'S') OR ends_with(p_type, 'L') AS e, contains(p_name, 'e') AS f, array_to_string(list_filter(string_split(p_type, ' '), lambda x: x <> ''), '/') AS g, 'SomeNiceName' AS h, p_brand AS i, 'a' || upper(p_brand[1]) || lower(p_brand[2:]) AS j FROM part", extensions=True)
_add("ext_lists", "conversations", _slots("conversations", {"id": {"populated_from": "conv_id"}, "s": _e("sum(turns.turn)"), "l": _e("last(sorted(turns.turn))"), "r": _e("first(reversed(turns.role))"), "y": _e("any([t.turn > 2 for t in turns])"), "z": _e("all([t.turn >= 0 for t in turns])"), "u": _e("floor(sum(turns.turn) / 4)"), "v": _e("ceil(sum(turns.turn) / 4)"), "w": _e("is_list(turns) and is_int(conv_id) and not is_str(conv_id)")}),
     "SELECT conv_id AS id, sum(turn)::BIGINT AS s, max(turn) AS l, arg_max(role, turn) AS r, max(turn) > 2 AS y, min(turn) >= 0 AS z, floor(sum(turn) / 4)::BIGINT AS u, ceil(sum(turn) / 4)::BIGINT AS v, TRUE AS w FROM conversations GROUP BY 1", prepare=_turns, schema=_turn_schema, extensions=True)


_NINTH = _slots("customer", {"id": {"populated_from": "c_custkey"}, "ninth": _e("c_mktsegment[8]"), "lower": _e("lower(slot('ninth'))")})
_add("failing_rows_left_out", "customer", _NINTH, "SELECT c_custkey AS id, substr(c_mktsegment, 9, 1) AS ninth, lower(substr(c_mktsegment, 9, 1)) AS lower FROM customer WHERE length(c_mktsegment) > 8", on_error="collect")


def failing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a mapping rejects, as they were read."""
    mapper = Mapper(_NINTH, on_error="collect")
    mapper.transform(table(spark, sf_dir, "customer"), "customer")
    return mapper.rejected["customer"].select("c_custkey", "c_mktsegment")


ORACLES["failing_rows"] = "SELECT c_custkey, c_mktsegment FROM customer WHERE length(c_mktsegment) <= 8"


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise SpecError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        at = tempfile.mkdtemp(prefix="specloom-")
    return f"{at}/query-{uuid.uuid4().hex}"


def _round_trip(kind: str):
    """Mapped rows written in one format, read back with the schema's types and mapped again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = f"{_folder(spark)}.{kind}"
        first = Mapper(_slots("part", {"k": {"populated_from": "p_partkey", "range": "integer"}, "name": {"populated_from": "p_name"}, "price": {"populated_from": "p_retailprice"}, "note": _e("p_type + ',\"' + p_brand")})).transform(table(spark, sf_dir, "part"), "part")
        io.write(first, at)
        schema = Schema({"classes": {"Out": {"attributes": {"k": {"range": "integer"}, "name": {}, "price": {"range": "float"}, "note": {}}}}})
        back = io.read(spark, at, schema, "Out")
        return Mapper({"class_derivations": {"Out": {"slot_derivations": {"k": None, "name": None, "price": None, "note": None}}}}, schema).transform(back, "Out")

    return query


_FORMATS = ("csv", "tsv", "jsonl", "parquet")
ORACLES |= {f"round_trip_{k}": "SELECT p_partkey AS k, p_name AS name, p_retailprice AS price, p_type || ',\"' || p_brand AS note FROM part" for k in _FORMATS}


def queries() -> dict:
    made = {n: _run(n) for n in _SPECS} | {"lookup_two_stage": lookup_two_stage, "stream_stateless_map": stream_stateless_map, "reference_in_container": reference_in_container, "failing_rows": failing_rows}
    return made | {f"round_trip_{k}": _round_trip(k) for k in _FORMATS}
