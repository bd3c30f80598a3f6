"""The engine's own queries over the fixture tables, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    Arg, Engine, Frames, ParquetFolder, Table, abs_, add, and_, array_all, array_contained_by, array_contains, array_has, array_overlaps, asc, avg, ceil, contains, cosine_distance, count, count_distinct, desc, div, ends_with, eq, fk, floor,
    gt, gte, hamming_distance, inner_product, is_in, is_not_null, is_null, jaccard_distance, l1_distance, l2_distance, left, length, like, lower, lt, lte, many, max_, min_, mod, mul, ne, not_in, one, or_, pk, position, power, prepare, relations,
    right, round_, sql, st_distance, st_dwithin, st_intersects, starts_with, sub, sum_, trim, trunc, types, upper,
)
from .schema import Col

big, integer, text, double, ts = types.bigint(), types.integer(), types.text(), types.double(), types.timestamp()


def key(t=integer) -> Col:
    return Col(t).primary_key()


region = Table("region", {"r_regionkey": key(), "r_name": text})
nation = Table("nation", {"n_nationkey": key(), "n_name": text, "n_regionkey": Col(integer).references(lambda: region.r_regionkey)})
customer = Table("customer", {"c_custkey": key(big), "c_name": text, "c_nationkey": Col(integer).references(lambda: nation.n_nationkey), "c_acctbal": double, "c_mktsegment": text})
supplier = Table("supplier", {"s_suppkey": key(big), "s_name": text, "s_nationkey": Col(integer).references(lambda: nation.n_nationkey), "s_acctbal": double})
part = Table("part", {"p_partkey": key(big), "p_name": text, "p_brand": text, "p_type": text, "p_size": integer, "p_retailprice": double})
orders = Table("orders", {"o_orderkey": key(big), "o_custkey": Col(big).references(lambda: customer.c_custkey), "o_orderstatus": text, "o_totalprice": double, "o_orderdate": ts, "o_orderpriority": text})
lineitem = Table(
    "lineitem",
    {
        "l_orderkey": Col(big).references(lambda: orders.o_orderkey), "l_partkey": Col(big).references(lambda: part.p_partkey), "l_suppkey": Col(big).references(lambda: supplier.s_suppkey), "l_linenumber": integer, "l_quantity": double, "l_extendedprice": double,
        "l_discount": double, "l_tax": double, "l_returnflag": text, "l_linestatus": text, "l_shipdate": ts,
    },
)
events = Table("events", {"event_id": key(big), "ts": ts, "user_id": big, "event_type": text, "value": double, "props": text})
documents = Table("documents", {"doc_id": key(big), "text": text, "lang": text, "source": text, "n_chars": big})
labels = Table("labels", {"doc_id": Col(big).unique().references(lambda: documents.doc_id), "quality": integer, "toxic": integer})
embeddings = Table("embeddings", {"vec_id": key(big), "embedding": types.vector(64), "label": integer})
conversations = Table("conversations", {"conv_id": big, "turn": big, "role": text, "text": text})
TABLES = (region, nation, customer, supplier, part, orders, lineitem, events, documents, labels, embeddings, conversations)
RELATIONS = (
    relations(region, {"nations": many(nation)}),
    relations(nation, {"region": fk(region), "customers": many(customer), "suppliers": many(supplier)}),
    relations(customer, {"nation": fk(nation), "orders": many(orders), "first_order": one(orders)}),
    relations(orders, {"customer": fk(customer), "items": many(lineitem)}),
    relations(lineitem, {"order": fk(orders), "part": fk(part)}),
    relations(documents, {"label": one(labels)}),
    relations(labels, {"document": fk(documents)}),
)

Build = Callable[[Engine], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql_text: str | None, build: Build) -> None:
    QUERIES[name] = build
    if sql_text is not None:
        SQL[name] = sql_text


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, ParquetFolder(sf_dir), [*TABLES, *RELATIONS])


def flagship(db: Engine) -> DataFrame:
    """Revenue per market segment since 1996."""
    return (
        db.from_(orders)
        .inner_join(customer, eq(orders.o_custkey, customer.c_custkey))
        .inner_join(nation, eq(customer.c_nationkey, nation.n_nationkey))
        .select({"segment": customer.c_mktsegment, "n_orders": count("*"), "revenue": round_(sum_(orders.o_totalprice), 2)})
        .where(gte(orders.o_orderdate, dt.datetime(1996, 1, 1)))
        .having(gte(count("*"), 1))
        .order_by(desc("revenue"))
        .limit(10)
        .df
    )


query("flagship", "SELECT c_mktsegment AS segment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1 ORDER BY 3 DESC LIMIT 10", flagship)

# scans and projections
query("scan_all", "SELECT * FROM nation", lambda db: db.from_(nation).df)
query("project_cols", "SELECT c_custkey AS id, c_name AS name FROM customer", lambda db: db.from_(customer).select({"id": customer.c_custkey, "name": customer.c_name}).df)
query("project_alias_fn", "SELECT upper(n_name) AS n, length(n_name) AS k FROM nation", lambda db: db.from_(nation).select({"n": upper(nation.n_name), "k": length(nation.n_name)}).df)

# filters
O = {"k": orders.o_orderkey, "p": orders.o_totalprice}
for _op, _f in {"=": eq, "!=": ne, ">": gt, ">=": gte, "<": lt, "<=": lte}.items():
    query(f"where_{_f.__name__}", f"SELECT p_partkey AS k FROM part WHERE p_size {_op} 25", lambda db, f=_f: db.from_(part).select({"k": part.p_partkey}).where(f(part.p_size, 25)).df)
query("where_last_wins", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 400000", lambda db: db.from_(orders).select(O).where(lt(orders.o_totalprice, 10)).where(gt(orders.o_totalprice, 400000)).df)
query("where_date", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01'", lambda db: db.from_(orders).select(O).where(lt(orders.o_orderdate, dt.datetime(1995, 3, 1))).df)
query("where_raw", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice % 7 < 1", lambda db: db.from_(orders).select(O).where(sql("{0} % {1} < 1", orders.o_totalprice, 7)).df)
query("cmp_null_literal", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = NULL", lambda db: db.from_(orders).select({"k": orders.o_orderkey}).where(eq(orders.o_orderstatus, None)).df)
query("cmp_col_col", "SELECT count(*) AS n FROM lineitem WHERE l_partkey > l_orderkey", lambda db: db.from_(lineitem).select({"n": count("*")}).where(gt(lineitem.l_partkey, lineitem.l_orderkey)).df)
query("cmp_fn_fn", "SELECT p_partkey AS k FROM part WHERE length(p_name) > length(p_type)", lambda db: db.from_(part).select({"k": part.p_partkey}).where(gt(length(part.p_name), length(part.p_type))).df)
query("cmp_fn_lit", "SELECT p_partkey AS k FROM part WHERE length(trim(p_name)) = 12", lambda db: db.from_(part).select({"k": part.p_partkey}).where(eq(length(trim(part.p_name)), 12)).df)


def _rich(db: Engine):
    rich = db.cte("rich", db.from_(orders).select({"ck": orders.o_custkey, "ok": orders.o_orderkey}).where(gt(orders.o_totalprice, 400000)))
    return rich, db.with_(rich).from_(customer).left_join(rich, eq(customer.c_custkey, rich.ck))


_RICH = "customer LEFT JOIN (SELECT o_custkey AS ck, o_orderkey AS ok FROM orders WHERE o_totalprice > 400000) rich ON c_custkey = ck"
query("is_null", f"SELECT c_custkey AS k FROM {_RICH} WHERE ok IS NULL", lambda db: (lambda r, q: q.select({"k": customer.c_custkey}).where(is_null(r.ok)).df)(*_rich(db)))
query("is_not_null", f"SELECT c_custkey AS k, ok FROM {_RICH} WHERE ok IS NOT NULL", lambda db: (lambda r, q: q.select({"k": customer.c_custkey, "ok": r.ok}).where(is_not_null(r.ok)).df)(*_rich(db)))
query("in_list", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", lambda db: db.from_(orders).select(O).where(is_in(orders.o_orderpriority, ["1-URGENT", "2-HIGH"])).df)
query("in_empty", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE FALSE", lambda db: db.from_(orders).select(O).where(is_in(orders.o_orderpriority, [])).df)
query("not_in_list", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", lambda db: db.from_(orders).select(O).where(not_in(orders.o_orderstatus, ["F", "O"])).df)
query("not_in_empty", "SELECT count(*) AS n FROM orders", lambda db: db.from_(orders).select({"n": count("*")}).where(not_in(orders.o_orderstatus, [])).df)
query("in_subquery", "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", lambda db: db.from_(customer).select({"k": customer.c_custkey}).where(is_in(customer.c_custkey, db.from_(orders).select({"x": orders.o_custkey}).where(gt(orders.o_totalprice, 400000)))).df)
query("in_subquery_or", "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_acctbal < 0", lambda db: db.from_(customer).select({"k": customer.c_custkey}).where(or_(is_in(customer.c_custkey, db.from_(orders).select({"x": orders.o_custkey}).where(gt(orders.o_totalprice, 400000))), lt(customer.c_acctbal, 0))).df)
query("in_subquery_having", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 12) OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900)", lambda db: db.from_(orders).select({"k": orders.o_custkey, "n": count("*")}).having(or_(is_in(count("*"), db.from_(nation).select({"x": nation.n_nationkey}).where(gt(nation.n_nationkey, 12))), is_in(orders.o_custkey, db.from_(customer).select({"x": customer.c_custkey}).where(gt(customer.c_acctbal, 9900))))).df)
query("raw_numbered", "SELECT o_orderkey AS k, '$1' AS d FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000", lambda db: db.raw("SELECT o_orderkey AS k, '$1' AS d FROM orders WHERE o_totalprice > $2 AND o_orderstatus = $1", ["F", 300000]))
query("and_or_nested", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 300000 OR o_totalprice < 5000)", lambda db: db.from_(orders).select(O).where(and_(eq(orders.o_orderstatus, "F"), or_(gt(orders.o_totalprice, 300000), lt(orders.o_totalprice, 5000)))).df)
query("and_skips_none", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F'", lambda db: db.from_(orders).select(O).where(and_(None, eq(orders.o_orderstatus, "F"), and_())).df)
query("or_empty", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE FALSE", lambda db: db.from_(orders).select(O).where(or_(None)).df)
P = {"k": part.p_partkey, "n": part.p_name}
query("starts_with", "SELECT p_partkey AS k, p_name AS n FROM part WHERE starts_with(p_type, 'S')", lambda db: db.from_(part).select(P).where(starts_with(part.p_type, "S")).df)
query("ends_with", "SELECT p_partkey AS k, p_name AS n FROM part WHERE suffix(p_brand, '3')", lambda db: db.from_(part).select(P).where(ends_with(part.p_brand, "3")).df)
query("contains_", "SELECT p_partkey AS k, p_name AS n FROM part WHERE contains(p_name, 'a')", lambda db: db.from_(part).select(P).where(contains(part.p_name, "a")).df)
query("like_", "SELECT p_partkey AS k, p_name AS n FROM part WHERE p_name LIKE '%1_%'", lambda db: db.from_(part).select(P).where(like(part.p_name, "%1_%")).df)

# scalar functions
for _name, _e, _s in [
    ("length", length(part.p_name), "length(p_name)"), ("lower", lower(part.p_name), "lower(p_name)"), ("upper", upper(part.p_name), "upper(p_name)"), ("trim", trim(part.p_name), "trim(p_name, ' ')"), ("left", left(part.p_name, 4), "left(p_name, 4)"),
    ("right", right(part.p_name, 4), "right(p_name, 4)"), ("left_neg", left(part.p_name, -3), "left(p_name, -3)"), ("right_neg", right(part.p_name, -3), "right(p_name, -3)"), ("position", position(part.p_type, "A"), "strpos(p_type, 'A')"),
    ("nested", length(trim(upper(part.p_name))), "length(trim(upper(p_name)))"),
]:
    query(f"fn_{_name}", f"SELECT p_partkey AS k, {_s} AS v FROM part", lambda db, e=_e: db.from_(part).select({"k": part.p_partkey, "v": e}).df)
for _name, _e, _s in [
    ("arith_add", add(part.p_size, 7), "p_size + 7"), ("arith_sub", sub(part.p_partkey, part.p_size), "p_partkey - p_size"), ("arith_mul", mul(part.p_size, 3), "p_size * 3"), ("arith_div_int", div(sub(part.p_size, 30), 7), "(p_size - 30) // 7"),
    ("arith_div_float", round_(div(part.p_retailprice, 3), 4), "round(p_retailprice / 3, 4)"), ("arith_nested", round_(mul(add(part.p_retailprice, 1), sub(2, 0.5)), 4), "round((p_retailprice + 1) * 1.5, 4)"), ("math_mod", mod(sub(part.p_size, 30), 7), "(p_size - 30) % 7"),
]:
    query(_name, f"SELECT p_partkey AS k, {_s} AS v FROM part", lambda db, e=_e: db.from_(part).select({"k": part.p_partkey, "v": e}).df)
B = customer.c_acctbal
for _name, _e, _s in [
    ("abs", abs_(B), "abs(c_acctbal)"), ("round", round_(div(B, 7)), "round(c_acctbal / 7) + 0"), ("round_n", round_(div(B, 7), 2), "round(c_acctbal / 7, 2)"), ("ceil", ceil(B), "ceil(c_acctbal)"), ("floor", floor(B), "floor(c_acctbal)"), ("trunc", trunc(B), "trunc(c_acctbal)"),
    ("trunc_n", trunc(div(B, 7), 1), "sign(c_acctbal) * floor(abs(c_acctbal / 7) * 10) / 10"), ("power", round_(power(div(B, 1000), 2), 4), "round(pow(c_acctbal / 1000, 2), 4)"),
]:
    query(f"math_{_name}", f"SELECT c_custkey AS k, ({_s})::DOUBLE AS v FROM customer", lambda db, e=_e: db.from_(customer).select({"k": customer.c_custkey, "v": e}).df)

# joins
query("join_inner", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey", lambda db: db.from_(orders).inner_join(customer, eq(orders.o_custkey, customer.c_custkey)).select({"k": orders.o_orderkey, "n": customer.c_name}).df)
query("join_left", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", lambda db: db.from_(customer).left_join(orders, and_(eq(customer.c_custkey, orders.o_custkey), gt(orders.o_totalprice, 400000))).select({"k": customer.c_custkey, "o": orders.o_orderkey}).df)
query("join_three_way", "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", lambda db: db.from_(region).inner_join(nation, eq(region.r_regionkey, nation.n_regionkey)).inner_join(customer, eq(customer.c_nationkey, nation.n_nationkey)).select({"r": region.r_name, "n": count("*")}).df)
query("join_theta", "SELECT s_suppkey AS s, n_nationkey AS n FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 9000", lambda db: db.from_(supplier).inner_join(nation, and_(lt(supplier.s_nationkey, nation.n_nationkey), gt(supplier.s_acctbal, 9000))).select({"s": supplier.s_suppkey, "n": nation.n_nationkey}).df)
query("join_mixed", "SELECT c_custkey AS k, n_name AS n, o_orderkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE n_regionkey = 1", lambda db: db.from_(customer).inner_join(nation, eq(customer.c_nationkey, nation.n_nationkey)).left_join(orders, and_(eq(orders.o_custkey, customer.c_custkey), eq(orders.o_orderstatus, "P"))).select({"k": customer.c_custkey, "n": nation.n_name, "o": orders.o_orderkey}).where(eq(nation.n_regionkey, 1)).df)
query("join_all_columns", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey", lambda db: db.from_(nation).inner_join(region, eq(nation.n_regionkey, region.r_regionkey)).df)

# aggregates
L = lineitem
query("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders", lambda db: db.from_(orders).select({"n": count("*"), "s": round_(sum_(orders.o_totalprice), 2), "a": round_(avg(orders.o_totalprice), 4), "lo": min_(orders.o_orderdate), "hi": max_(orders.o_orderdate)}).df)
query("agg_count_col", f"SELECT count(ok) AS n, count(*) AS k FROM {_RICH}", lambda db: (lambda r, q: q.select({"n": count(r.ok), "k": count("*")}).df)(*_rich(db)))
query("agg_count_distinct", "SELECT count(DISTINCT o_custkey) AS n FROM orders", lambda db: db.from_(orders).select({"n": count_distinct(orders.o_custkey)}).df)
query("agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE FALSE", lambda db: db.from_(orders).select({"n": count("*"), "s": sum_(orders.o_totalprice)}).where(is_in(orders.o_orderkey, [])).df)
query("agg_auto_group", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1", lambda db: db.from_(orders).select({"s": orders.o_orderstatus, "n": count("*")}).df)
query("agg_auto_group_multi", "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS d, round(avg(l_discount), 6) AS a, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", lambda db: db.from_(L).select({"f": L.l_returnflag, "s": L.l_linestatus, "q": round_(sum_(L.l_quantity), 2), "d": round_(sum_(mul(L.l_extendedprice, sub(1, L.l_discount))), 2), "a": round_(avg(L.l_discount), 6), "n": count("*")}).where(lte(L.l_shipdate, dt.datetime(1998, 9, 2))).df)
query("agg_group_fn", "SELECT length(p_name) AS k, count(*) AS n FROM part GROUP BY 1", lambda db: db.from_(part).select({"k": length(part.p_name), "n": count("*")}).df)
query("agg_group_explicit", "SELECT max(p_size) AS m FROM part GROUP BY p_brand", lambda db: db.from_(part).select({"m": max_(part.p_size)}).group_by(part.p_brand).df)
query("agg_group_alias", "SELECT lower(p_brand) AS b, round(avg(p_retailprice), 4) AS a FROM part GROUP BY 1", lambda db: db.from_(part).select({"b": lower(part.p_brand), "a": round_(avg(part.p_retailprice), 4)}).group_by(lambda a: a["b"]).df)
query("agg_group_only", "SELECT DISTINCT p_brand AS b FROM part", lambda db: db.from_(part).select({"b": part.p_brand}).group_by(part.p_brand).df)
query("agg_having_lit", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12", lambda db: db.from_(orders).select({"c": orders.o_custkey, "n": count("*")}).having(gt(count("*"), 12)).df)
query("agg_having_hidden", "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING max(o_totalprice) > 10 * min(o_totalprice)", lambda db: db.from_(orders).select({"c": orders.o_custkey}).group_by(orders.o_custkey).having(gt(max_(orders.o_totalprice), mul(min_(orders.o_totalprice), 10))).df)
query("agg_expr_over_agg", "SELECT p_brand AS b, round(avg(p_size) * 2 + count(*), 3) AS v FROM part GROUP BY 1", lambda db: db.from_(part).select({"b": part.p_brand, "v": round_(add(mul(avg(part.p_size), 2), count("*")), 3)}).df)
query("agg_min_text", "SELECT p_type AS t, min(lower(p_name)) AS lo, max(p_brand) AS hi, sum(length(p_name))::BIGINT AS s FROM part GROUP BY 1", lambda db: db.from_(part).select({"t": part.p_type, "lo": min_(lower(part.p_name)), "hi": max_(part.p_brand), "s": sum_(length(part.p_name))}).df)
query("agg_sum_bigint", "SELECT sum(o_orderkey)::DECIMAL(38,0) AS s FROM orders", lambda db: db.from_(orders).select({"s": sum_(orders.o_orderkey)}).df)
query("agg_over_join", "SELECT n_name AS n, round(sum(s_acctbal * 2), 2) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", lambda db: db.from_(supplier).inner_join(nation, eq(supplier.s_nationkey, nation.n_nationkey)).select({"n": nation.n_name, "s": round_(sum_(mul(supplier.s_acctbal, 2)), 2)}).df)

# order, limit, distinct
query("order_nulls_asc", f"SELECT c_custkey AS k, ok FROM {_RICH} ORDER BY ok ASC NULLS LAST, k LIMIT 50", lambda db: (lambda r, q: q.select({"k": customer.c_custkey, "ok": r.ok}).order_by(asc(r.ok), asc(customer.c_custkey)).limit(50).df)(*_rich(db)))
query("order_nulls_desc", f"SELECT c_custkey AS k, ok FROM {_RICH} ORDER BY ok DESC NULLS FIRST, k LIMIT 50", lambda db: (lambda r, q: q.select({"k": customer.c_custkey, "ok": r.ok}).order_by(desc(r.ok), asc(customer.c_custkey)).limit(50).df)(*_rich(db)))
query("order_alias", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20", lambda db: db.from_(orders).select(O).order_by(desc("p"), asc("k")).limit(20).df)
query("order_fn", "SELECT p_partkey AS k, p_name AS n FROM part ORDER BY length(p_name), k LIMIT 20", lambda db: db.from_(part).select(P).order_by(asc(length(part.p_name)), asc(part.p_partkey)).limit(20).df)
query("order_hidden", "SELECT c_name AS n FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15", lambda db: db.from_(customer).select({"n": customer.c_name}).order_by(desc(customer.c_acctbal), asc(customer.c_custkey)).limit(15).df)
query("order_by_agg", "SELECT o_custkey AS c FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 10", lambda db: db.from_(orders).select({"c": orders.o_custkey}).group_by(orders.o_custkey).order_by(desc(count("*")), asc(orders.o_custkey)).limit(10).df)
query("topk", "SELECT event_id AS k, value AS v FROM events ORDER BY value DESC, event_id LIMIT 25", lambda db: db.from_(events).select({"k": events.event_id, "v": events.value}).order_by(desc(events.value), asc(events.event_id)).limit(25).df)
query("limit_offset", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY k LIMIT 30 OFFSET 100", lambda db: db.from_(orders).select(O).order_by(asc(orders.o_orderkey)).limit(30).offset(100).df)
query("distinct_on_one", "SELECT DISTINCT ON (o_custkey) o_custkey AS c, o_orderkey AS k FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", lambda db: db.from_(orders).distinct_on(orders.o_custkey).select({"c": orders.o_custkey, "k": orders.o_orderkey}).order_by(asc(orders.o_custkey), desc(orders.o_totalprice), asc(orders.o_orderkey)).df)
query("distinct_on_multi", "SELECT DISTINCT ON (o_orderstatus, o_orderpriority) o_orderstatus AS s, o_orderpriority AS p, o_orderkey AS k FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderstatus, o_orderpriority, o_orderdate, o_orderkey", lambda db: db.from_(orders).distinct_on(orders.o_orderstatus, orders.o_orderpriority).select({"s": orders.o_orderstatus, "p": orders.o_orderpriority, "k": orders.o_orderkey}).where(gt(orders.o_totalprice, 1000)).order_by(asc(orders.o_orderstatus), asc(orders.o_orderpriority), asc(orders.o_orderdate), asc(orders.o_orderkey)).df)
query("distinct_on_turn", "SELECT DISTINCT ON (conv_id) conv_id AS c, turn AS t, role AS r FROM conversations ORDER BY conv_id, turn DESC, role", lambda db: db.from_(conversations).distinct_on(conversations.conv_id).select({"c": conversations.conv_id, "t": conversations.turn, "r": conversations.role}).order_by(asc(conversations.conv_id), desc(conversations.turn), asc(conversations.role)).df)

# shortcuts
S = lambda db: db.shortcuts
_big = gt(orders.o_totalprice, 300000)
query("sc_count", "SELECT count(*) AS value FROM orders WHERE o_totalprice > 300000", lambda db: S(db).count_df(orders, _big))
query("sc_exists", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 300000) AS value", lambda db: S(db).exists_df(orders, _big))
query("sc_exists_not", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS value", lambda db: S(db).exists_df(orders, lt(orders.o_totalprice, 0)))
query("sc_first", "SELECT * FROM nation WHERE n_nationkey = 7", lambda db: S(db).first_df(nation, eq(nation.n_nationkey, 7)))
query("sc_sum", "SELECT round(sum(o_totalprice), 2) AS value FROM orders", lambda db: S(db).sum_df(orders, orders.o_totalprice).select(F.round("value", 2).alias("value")))
query("sc_avg", "SELECT round(avg(o_totalprice), 4) AS value FROM orders WHERE o_totalprice > 300000", lambda db: S(db).avg_df(orders, orders.o_totalprice, _big).select(F.round("value", 4).alias("value")))
query("sc_min", "SELECT min(o_orderdate) AS value FROM orders", lambda db: S(db).min_df(orders, orders.o_orderdate))
query("sc_max", "SELECT max(c_name) AS value FROM customer", lambda db: S(db).max_df(customer, customer.c_name))
query("sc_distinct", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0", lambda db: S(db).distinct_df(customer, customer.c_mktsegment, gt(customer.c_acctbal, 0)))


# named queries
def _totals(db: Engine):
    return db.cte("totals", db.from_(orders).select({"c": orders.o_custkey, "total": sum_(orders.o_totalprice), "n": count("*")}))


_TOTALS = "WITH totals AS (SELECT o_custkey AS c, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1)"
query("cte_simple", f"{_TOTALS} SELECT c, n FROM totals WHERE n > 11", lambda db: (lambda t: db.with_(t).from_(lambda c: c.totals).select({"c": t.c["c"], "n": t.c["n"]}).where(gt(t.c["n"], 11)).df)(_totals(db)))
query("cte_join", f"{_TOTALS} SELECT c_name AS name, round(total, 2) AS total FROM customer JOIN totals ON c_custkey = c WHERE n > 11", lambda db: (lambda t: db.with_(t).from_(customer).inner_join(t, eq(customer.c_custkey, t.c["c"])).select({"name": customer.c_name, "total": round_(t.total, 2)}).where(gt(t.n, 11)).df)(_totals(db)))


def _chained(db: Engine) -> DataFrame:
    t = _totals(db)
    top = db.cte("top", db.from_(t).select({"n": t.n, "best": max_(t.total)}))
    return db.with_(t, top).from_(top).select({"n": top.n, "best": round_(top.best, 2)}).df


query("cte_chained", f"{_TOTALS}, top AS (SELECT n, max(total) AS best FROM totals GROUP BY 1) SELECT n, round(best, 2) AS best FROM top", _chained)
query("cte_in_subquery", f"{_TOTALS} SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT c FROM totals WHERE n > 11)", lambda db: (lambda t: db.with_(t).from_(customer).select({"k": customer.c_custkey}).where(is_in(customer.c_custkey, db.from_(t).select({"c": t.c["c"]}).where(gt(t.n, 11)))).df)(_totals(db)))
query("cte_fn_col", "WITH u AS (SELECT upper(n_name) AS name, length(n_name) AS k FROM nation) SELECT name, k + 1 AS k FROM u", lambda db: (lambda u: db.with_(u).from_(u).select({"name": u.c["name"], "k": add(u.k, 1)}).df)(db.cte("u", db.from_(nation).select({"name": upper(nation.n_name), "k": length(nation.n_name)}))))

# prepared queries and raw SQL
_by_price = prepare({"z": double, "a": double, "n": Arg.bigint("n")}, lambda db, a: db.from_(orders).select(O).where(and_(gt(orders.o_totalprice, a.z), lt(orders.o_totalprice, a.a), gt(orders.o_totalprice, a.z))).order_by(asc(orders.o_orderkey)).limit(a.n))
query("prep_select", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 90000 ORDER BY k LIMIT 40", lambda db: _by_price.run(db, z=1000.0, a=90000.0, n=40))
query("prep_find_many", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2", lambda db: prepare({"r": integer}, lambda e, a: e.find_many(nation, columns={"n_regionkey": False}, where=eq(nation.n_regionkey, a.r))).run(db, r=2))
query("raw_sql", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1", lambda db: db.raw("SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1"))
query("raw_params", "SELECT n_name FROM nation WHERE n_regionkey = 3", lambda db: db.raw("SELECT n_name FROM nation WHERE n_regionkey = :r", {"r": 3}))
query("raw_rows", "SELECT count(*) AS n FROM nation", lambda db: db.raw("SELECT * FROM nation", rows=lambda df: df.agg(F.count(F.lit(1)).alias("n"))))

# relations
_keys = lambda c, k: F.array_join(F.transform(c, lambda x: x[k].cast("string")), ",")
query("rel_many_count", "SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1", lambda db: db.find_many(region, with_={"nations": True}).df.select("r_regionkey", F.size("nations").cast("long").alias("n")))
query("rel_many_keys_ordered", "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS ks FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1", lambda db: db.find_many(region, with_={"nations": {"columns": {"n_name": True}, "order_by": desc(nation.n_name)}}).df.select("r_regionkey", _keys("nations", "n_name").alias("ks")))
query("rel_many_where", "SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_totalprice > 400000), '') AS ks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", lambda db: db.find_many(customer, columns={"c_custkey": True}, with_={"orders": {"where": gt(orders.o_totalprice, 400000), "order_by": asc(orders.o_orderkey)}}).df.select("c_custkey", _keys("orders", "o_orderkey").alias("ks")))
_RANKED = "(SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)"
query("rel_many_limit", f"SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 2), '') AS ks FROM customer LEFT JOIN {_RANKED} ON o_custkey = c_custkey GROUP BY 1", lambda db: db.find_many(customer, with_={"orders": {"order_by": [desc(orders.o_totalprice), asc(orders.o_orderkey)], "limit": 2}}).df.select("c_custkey", _keys("orders", "o_orderkey").alias("ks")))
query("rel_many_offset", f"SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) FILTER (rn IN (2, 3)), '') AS ks FROM customer LEFT JOIN {_RANKED} ON o_custkey = c_custkey GROUP BY 1", lambda db: db.find_many(customer, with_={"orders": {"order_by": [desc(orders.o_totalprice), asc(orders.o_orderkey)], "limit": 2, "offset": 1}}).df.select("c_custkey", _keys("orders", "o_orderkey").alias("ks")))
query("rel_many_empty", "SELECT c_custkey, 0::BIGINT AS n FROM customer", lambda db: db.find_many(customer, with_={"orders": {"where": lt(orders.o_totalprice, 0)}}).df.select("c_custkey", F.size("orders").cast("long").alias("n")))
query("rel_one", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", lambda db: db.find_many(documents, columns={"doc_id": True}, with_={"label": True}).df.select("doc_id", "label.quality", "label.toxic"))
query("rel_fk", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000", lambda db: db.find_many(orders, columns={"o_orderkey": True}, where=gt(orders.o_totalprice, 400000), with_={"customer": {"columns": {"c_name": True, "c_mktsegment": True}}}).df.select("o_orderkey", "customer.c_name", "customer.c_mktsegment"))
query("rel_nested2", "SELECT r_regionkey, string_agg(n_nationkey::VARCHAR || ':' || k::VARCHAR, ',' ORDER BY n_nationkey) AS ks FROM region JOIN (SELECT n_regionkey, n_nationkey, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2) ON r_regionkey = n_regionkey GROUP BY 1", lambda db: db.find_many(region, with_={"nations": {"order_by": asc(nation.n_nationkey), "with_": {"suppliers": True}}}).df.select("r_regionkey", F.array_join(F.transform("nations", lambda x: F.concat_ws(":", x.n_nationkey.cast("string"), F.size(x.suppliers).cast("string"))), ",").alias("ks")))
query("rel_nested3", "SELECT n_nationkey, count(DISTINCT c_custkey) AS c, count(o_orderkey) AS o FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", lambda db: db.find_many(nation, with_={"customers": {"with_": {"orders": {"columns": {"o_orderkey": True}}}}, "region": True}).df.select("n_nationkey", F.size("customers").cast("long").alias("c"), F.aggregate("customers", F.lit(0).cast("long"), lambda a, x: a + F.size(x.orders)).alias("o")))
query("rel_two_branches", "SELECT n_nationkey, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation JOIN region ON n_regionkey = r_regionkey", lambda db: db.find_many(nation, with_={"customers": True, "suppliers": True, "region": True}).df.select("n_nationkey", "region.r_name", F.size("customers").cast("long").alias("c"), F.size("suppliers").cast("long").alias("s")))
query("rel_find_first", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1", lambda db: db.find_first(customer, columns={"c_custkey": True, "c_name": True}, order_by=[desc(customer.c_acctbal), asc(customer.c_custkey)], with_={"nation": True}).df.drop("nation"))
query("rel_limit_offset", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 10 OFFSET 5", lambda db: db.find_many(orders, columns={"o_orderkey": True}, order_by=asc(orders.o_orderkey), limit=10, offset=5, with_={"customer": True}).df.select("o_orderkey", "customer.c_name"))


# arrays
def _typed(db: Engine, build) -> DataFrame:
    """A query over each user's sorted event types."""
    t = Table("kinds", {"u": key(big), "types": types.text().array(), "grid": types.text().array(None, None)})
    base = db.frame(events).groupBy(F.col("user_id").alias("u")).agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    base = base.withColumn("types", F.filter("types", lambda x: (F.length(x) + F.col("u")) % 3 != 0)).withColumn("grid", F.array("types", F.array(F.lit("x"))))
    return build(Engine(db.spark, Frames({"kinds": base}), [t]), t)


_KINDS = "WITH kinds AS (SELECT user_id AS u, list_filter(list_sort(list(DISTINCT event_type)), lambda x: (length(x) + user_id) % 3 != 0) AS types FROM events GROUP BY user_id)"
for _name, _f, _s in [
    ("contains", lambda t: array_contains(t.types, ["click", "view"]), "list_has_all(types, ['click', 'view'])"), ("contained_by", lambda t: array_contained_by(t.types, ["click", "view", "signup"]), "list_has_all(['click', 'view', 'signup'], types)"),
    ("overlaps", lambda t: array_overlaps(t.types, ["purchase", "error"]), "list_has_any(types, ['purchase', 'error'])"), ("has", lambda t: array_has(t.types, "view"), "list_contains(types, 'view')"), ("all", lambda t: array_all(t.types, "view"), "len(list_filter(types, lambda x: x != 'view')) = 0"),
    ("flatten2d", lambda t: array_contains(t.grid, ["x", "click"]), "list_contains(types, 'click')"),
]:
    query(f"arr_{_name}", f"{_KINDS} SELECT u FROM kinds WHERE {_s}", lambda db, f=_f: _typed(db, lambda e, t: e.from_(t).select({"u": t.u}).where(f(t)).df))

# vectors
E = embeddings
_probe = [round(((i * 37) % 17 - 8) / 8, 3) for i in range(64)]
_V, _P = "list_transform(embedding, lambda x: x::DOUBLE)", f"{_probe}::DOUBLE[]"
for _name, _e, _s in [
    ("l2", l2_distance(E.embedding, _probe), f"list_distance({_V}, {_P})"), ("ip", inner_product(E.embedding, _probe), f"-list_inner_product({_V}, {_P})"), ("cosine", cosine_distance(E.embedding, _probe), f"list_cosine_distance({_V}, {_P})"),
    ("l1", l1_distance(E.embedding, _probe), f"list_sum(list_transform(list_zip({_V}, {_P}), lambda x: abs(x[1] - x[2])))"),
]:
    query(f"vec_{_name}", f"SELECT vec_id AS k, round({_s}, 4) AS d FROM embeddings", lambda db, e=_e: db.from_(E).select({"k": E.vec_id, "d": round_(e, 4)}).df)
query("vec_knn", f"SELECT vec_id AS k FROM embeddings ORDER BY list_distance({_V}, {_P}), vec_id LIMIT 10", lambda db: db.from_(E).select({"k": E.vec_id}).order_by(asc(l2_distance(E.embedding, _probe)), asc(E.vec_id)).limit(10).df)
query("vec_filter", f"SELECT vec_id AS k FROM embeddings WHERE list_cosine_distance({_V}, {_P}) < 0.95", lambda db: db.from_(E).select({"k": E.vec_id}).where(lt(cosine_distance(E.embedding, _probe), 0.95)).df)


def _bits(db: Engine, build) -> DataFrame:
    t = Table("signs", {"k": key(big), "b": types.bit(64)})
    base = db.frame(E).select(F.col("vec_id").alias("k"), F.array_join(F.transform("embedding", lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "").alias("b"))
    return build(Engine(db.spark, Frames({"signs": base}), [t]), t)


_SIGNS = "WITH signs AS (SELECT vec_id AS k, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings)"
_MASK = "10" * 32
_MASKED = "list_zip(b, list_transform(range(64), lambda i: ((i + 1) % 2)::INT))"
query("bit_hamming", f"{_SIGNS} SELECT k, list_sum(list_transform({_MASKED}, lambda x: (x[1] != x[2])::INT))::DOUBLE AS d FROM signs", lambda db: _bits(db, lambda e, t: e.from_(t).select({"k": t.k, "d": hamming_distance(t.b, _MASK)}).df))
query("bit_jaccard", f"{_SIGNS} SELECT k, round(1 - list_sum(list_transform({_MASKED}, lambda x: x[1] * x[2])) / list_sum(list_transform({_MASKED}, lambda x: greatest(x[1], x[2]))), 6) AS d FROM signs", lambda db: _bits(db, lambda e, t: e.from_(t).select({"k": t.k, "d": round_(jaccard_distance(t.b, _MASK), 6)}).df))


# geography
def _places(db: Engine, build) -> DataFrame:
    t = Table("places", {"k": key(big), "at": types.point()})
    k = F.col("c_custkey")
    base = db.frame(customer).select(k.alias("k"), F.struct(((k * 37) % 360 - 180).cast("double").alias("lon"), ((k * 11) % 170 - 85).cast("double").alias("lat")).alias("at"))
    return build(Engine(db.spark, Frames({"places": base}), [t]), t)


_PLACES = """
WITH RECURSIVE f AS (SELECT 1 / 298.257223563 AS f, 6378137.0::DOUBLE AS a, 6378137.0 * (1 - 1 / 298.257223563) AS b),
  p AS (SELECT c_custkey AS k, radians(((c_custkey * 37) % 360 - 180)::DOUBLE) AS lon, radians(((c_custkey * 11) % 170 - 85)::DOUBLE) AS lat FROM customer),
  u AS (SELECT k, atan((1 - f) * tan(lat)) AS s1, atan((1 - f) * tan(radians(40.7128))) AS s2, radians(-74.006) - lon AS diff,
    2 * 6371008.8 * asin(least(1, sqrt(pow(sin((radians(40.7128) - lat) / 2), 2) + cos(lat) * cos(radians(40.7128)) * pow(sin((radians(-74.006) - lon) / 2), 2)))) AS sphere FROM p, f),
  w AS (SELECT k, 0 AS i, s1, s2, diff, sphere, diff AS lam, NULL::DOUBLE AS was, 0::DOUBLE AS s, 0::DOUBLE AS c, 0::DOUBLE AS cos2, 0::DOUBLE AS mid FROM u
    UNION ALL SELECT k, i + 1, s1, s2, diff, sphere, diff + (1 - kk) * f * alpha * (atan2(s, c) + kk * s * (mid + kk * c * (2 * mid * mid - 1))), lam, s, c, cos2, mid
    FROM (SELECT *, f / 16 * cos2 * (4 + f * (4 - 3 * cos2)) AS kk FROM (SELECT *, CASE WHEN cos2 > 1e-12 THEN c - 2 * sin(s1) * sin(s2) / cos2 ELSE 0 END AS mid FROM (SELECT *, 1 - alpha * alpha AS cos2 FROM
      (SELECT *, CASE WHEN s > 0 THEN cos(s1) * cos(s2) * sin(lam) / s ELSE 0 END AS alpha FROM
        (SELECT k, i, s1, s2, diff, sphere, lam, sqrt(pow(cos(s2) * sin(lam), 2) + pow(cos(s1) * sin(s2) - sin(s1) * cos(s2) * cos(lam), 2)) AS s, sin(s1) * sin(s2) + cos(s1) * cos(s2) * cos(lam) AS c FROM w WHERE i < 21)))), f)),
  l AS (SELECT w.*, f.b, cos2 * (f.a * f.a - f.b * f.b) / (f.b * f.b) AS q FROM w, f WHERE i = 21),
  m AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS big, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS small FROM l),
  d AS (SELECT k, CASE WHEN abs(lam - was) > 1e-9 OR abs(was) > pi() THEN sphere ELSE b * big * (atan2(s, c) - small * s * (mid + small / 4 * (c * (2 * mid * mid - 1) - small / 6 * mid * (4 * s * s - 3) * (4 * mid * mid - 3)))) END AS d FROM m)"""
_NYC = (-74.006, 40.7128)
query("geo_distance", f"{_PLACES} SELECT k, round(d, 1) AS d FROM d", lambda db: _places(db, lambda e, t: e.from_(t).select({"k": t.k, "d": round_(st_distance(t.at, _NYC), 1)}).df))
query("geo_dwithin", f"{_PLACES} SELECT k FROM d WHERE d <= 3000000", lambda db: _places(db, lambda e, t: e.from_(t).select({"k": t.k}).where(st_dwithin(t.at, _NYC, 3_000_000)).df))
query("geo_intersects", "SELECT c_custkey AS k FROM customer WHERE (c_custkey * 37) % 360 - 180 = -143 AND (c_custkey * 11) % 170 - 85 = -74", lambda db: _places(db, lambda e, t: e.from_(t).select({"k": t.k}).where(st_intersects(t.at, (-143, -74))).df))


# changes, on a copy of nation in a store
def _changed(db: Engine, change: Callable[[Engine, Table], DataFrame | None]) -> DataFrame:
    t = Table("nation", {"n_nationkey": key(), "n_name": text, "n_regionkey": Col(integer).not_null()})
    e = Engine(db.spark, new_store(db), [t])
    e.insert(t).values(db.frame(nation)).execute()
    shown = change(e, t)
    return e.frame(t) if shown is None else shown


def new_store(db: Engine):
    """An empty store in the folder that driver and executors share; of this machine only where none is set and the master is local."""
    import tempfile
    import uuid

    from .sources.store import Store

    place = db.spark.conf.get("spark.checkpoint.dir", None) or db.spark.sparkContext.getConf().get("spark.checkpoint.dir") or None
    if place is None:
        if not db.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        place = "file://" + tempfile.mkdtemp(prefix="sparkrel-store-")
    return Store(db.spark, f"{place.rstrip('/')}/store-{uuid.uuid4().hex}")


_upsert = [{"n_nationkey": 3, "n_name": "three", "n_regionkey": 0}, {"n_nationkey": 99, "n_name": "new", "n_regionkey": 4}]
query("dml_insert_returning", "SELECT 77 AS n_nationkey, 'x' AS n_name", lambda db: _changed(db, lambda e, t: e.insert(t).values({"n_nationkey": 77, "n_name": "x", "n_regionkey": 1}).returning({"n_regionkey": False}).execute()))
query("dml_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'three' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'new', 4", lambda db: _changed(db, lambda e, t: e.insert(t).values(_upsert).on_conflict(t.n_nationkey).do_update_set(lambda x: {"n_name": x.n_name}).execute()))
query("dml_upsert_nothing", "SELECT * FROM nation UNION ALL SELECT 99, 'new', 4", lambda db: _changed(db, lambda e, t: e.insert(t).values(_upsert).on_conflict(t.n_nationkey).do_nothing().execute()))
query("dml_update_returning", "SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation WHERE n_regionkey = 2", lambda db: _changed(db, lambda e, t: e.update(t).set({"n_name": lower(t.n_name)}).where(eq(t.n_regionkey, 2)).returning().execute()))
query("dml_delete_returning", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2", lambda db: _changed(db, lambda e, t: e.delete(t).where(eq(t.n_regionkey, 2)).returning({"n_nationkey": True}).execute()))
query("dml_delete_state", "SELECT * FROM nation WHERE n_regionkey != 2", lambda db: _changed(db, lambda e, t: e.delete(t).where(eq(t.n_regionkey, 2)).execute()))
query("dml_cte", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1", lambda db: _changed(db, lambda e, t: (lambda gone: e.with_(gone).from_(gone).select({"n": gone.n_name}).df)(e.cte("gone", e.delete(t).where(eq(t.n_regionkey, 1)).returning()))))

from . import catalogue_changes  # noqa: E402, F401  (registers its queries)

__all__ = ["QUERIES", "SQL", "engine", "flagship", "pk"]
