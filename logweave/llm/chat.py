"""Tool calls in chats: linked to results, ordered, validated, serialised.

``link`` takes calls (call_id, conv_id, turn, name, arguments as JSON text,
after: the call whose result this one uses), results (call_id, content) and the
argument schemas of the tools.  Calls meet results in a hash join on the
identifier, of which equal results of a call are first reduced to one.  The place in a
topological order is (depth, turn, call_id), depth being the length of the longest chain
of ``after`` links before a call.  It comes from pointer doubling, in which every
call learns the one twice as far back each round, so a chain of any length
takes a logarithmic number of rounds and no conversation is gathered; calls that are
given several ``after`` (in repeated rows) are solved between the chains, in as many
further rounds as such calls follow each other.
Arguments are parsed to variants, whose objects have sorted keys, checked
against the schema by their types and written back as canonical JSON.  Numbers
keep all digits: they travel through the variant as marked strings (the mark is a digest
of the text, which the text cannot hold) in their canonical form, the same for equal values:
no sign of zero, no zeros before the first or after the last digit, plain up to 21 places before
the point and six zeros behind it, else with an exponent.  ``integer`` is any number without a fraction.

Defined cases: a NULL or malformed ``arguments`` (not an object, a repeated key)
is invalid and serialised as null; an unknown tool is invalid; ``after`` of an
unknown call counts as none and is an error; calls on a cycle or behind one have
a NULL depth and are an error; a call with several different results is returned once for each,
``n_results`` telling how often that one occurred; calls without result have a NULL result;
calls with a NULL id link to nothing; repeated calls are returned as often as they occur; extra columns of
calls stay (names beginning with an underscore are the operator's own).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: tool: {argument: (type, required)}
Schemas = dict[str, dict[str, tuple[str, bool]]]
_TYPES = {"string": r"^STRING$", "boolean": r"^BOOLEAN$", "array": r"^ARRAY<.*", "object": r"^OBJECT<.*"}
#: A string, a bare word (a number or a literal), or a single sign of JSON.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s,:\[\]{}"]++|[\s\S]'
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]{1,15})?$"


def canonical_number(token: Column) -> Column:
    """The one text of a JSON number's value."""
    mantissa = F.regexp_replace(token, "^-|[eE].*$", "")
    fraction = F.regexp_extract(mantissa, r"\.(.*)$", 1)
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", "")
    kept = F.regexp_replace(digits, "0+$", "")
    power = F.coalesce(F.nullif(F.regexp_extract(token, r"[eE]\+?(.*)$", 1), F.lit("")).cast("long"), F.lit(0))
    tail = power - F.length(fraction) + F.length(digits) - F.length(kept)  # value: kept * 10^tail
    places = F.length(kept) + tail  # digits before the point
    first, rest = F.left(kept, F.lit(1)), F.substring(kept, 2, 1 << 30)
    text = (F.when(places.between(1, 21) & (tail >= 0), F.concat(kept, F.repeat(F.lit("0"), tail.cast("int"))))
            .when(places.between(1, 21), F.concat(F.left(kept, places.cast("int")), F.lit("."),
                                                  F.substr(kept, places.cast("int") + 1)))
            .when(places.between(-5, 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), (-places).cast("int")), kept))
            .otherwise(F.concat(first, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"),
                                F.when(places > 0, F.lit("+")).otherwise(""), (places - 1).cast("string"))))
    return F.when(kept == "", F.lit("0")).otherwise(F.concat(F.when(token.startswith("-"), "-").otherwise(""), text))


def marked_arguments(raw: Column, mark: Column) -> Column:
    """The variant of a JSON text with every number as the string mark:number:mark."""
    tokens = F.regexp_extract_all(raw, F.lit(_TOKEN), F.lit(0))
    text = F.array_join(F.transform(tokens, lambda t: F.when(
        t.rlike(_NUMBER), F.concat(F.lit('"'), mark, F.lit(":"), canonical_number(t), F.lit(":"), mark, F.lit('"'))).otherwise(t)), "")
    return F.try_parse_json(text)


def unmarked(json: Column, mark: Column) -> Column:
    return F.replace(F.replace(json, F.concat(F.lit('"'), mark, F.lit(":")), F.lit("")), F.concat(F.lit(":"), mark, F.lit('"')), F.lit(""))


def _anchors(links: DataFrame) -> DataFrame:
    """(call_id, anchor, far) of calls (call_id, up): the end of the chain of ``up``
    and the way to it; NULL anchor on cycles."""
    cur = materialize(links.select("call_id", "up", F.coalesce("up", "call_id").alias("anchor"),
                                   F.col("up").isNotNull().cast("long").alias("far")))
    rounds, limit = 0, math.ceil(math.log2(max(2, cur.count()))) + 1
    while rounds < limit and not cur.where("up is not null").isEmpty():
        back = cur.select(F.col("call_id").alias("_k"), F.col("up").alias("_up"), F.col("anchor").alias("_anchor"),
                          F.col("far").alias("_far"))
        cur = materialize(
            cur.join(back, F.col("up") == F.col("_k"), "left")
            .select("call_id", F.col("_up").alias("up"), F.coalesce("_anchor", "anchor").alias("anchor"),
                    (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far")))
        rounds += 1
    return cur.select("call_id", F.when(F.col("up").isNull(), F.col("anchor")).alias("anchor"), "far")


def depths(links: DataFrame) -> DataFrame:
    """(call_id, depth) of calls with all their different (call_id, after); NULL on
    cycles and behind them."""
    known = links.select(F.col("call_id").alias("_k")).distinct()
    real = materialize(links.join(known, F.col("after") == F.col("_k"), "left").groupBy("call_id", F.col("_k").alias("up"))
                       .agg(F.lit(1).alias("_one")).drop("_one"))
    per = real.groupBy("call_id").agg(F.count("up").alias("_ups"), F.max("up").alias("up"))
    # a chain ends at a call without predecessor or with several
    chains = _anchors(per.select("call_id", F.when(F.col("_ups") == 1, F.col("up")).alias("up")))
    several = materialize(per.where("_ups > 1").select(F.col("call_id").alias("_several")))
    solved = materialize(chains.where("far = 0").join(several, F.col("call_id") == F.col("_several"), "left_anti")
                         .select(F.col("anchor").alias("_a"), F.lit(0).cast("long").alias("_depth")))
    if not several.isEmpty():
        ups = materialize(real.where("up is not null").join(several, F.col("call_id") == F.col("_several"), "left_semi")
                          .withColumnRenamed("call_id", "_m").join(chains, F.col("up") == F.col("call_id"))
                          .select("_m", "anchor", "far"))
        while True:
            open_ = ups.join(solved.select(F.col("_a").alias("_s")), F.col("_m") == F.col("_s"), "left_anti")
            # all predecessors' chains must end at a solved call
            new = materialize(open_.join(solved, F.col("anchor") == F.col("_a"), "left").groupBy("_m")
                              .agg(F.max(F.col("_depth") + F.col("far") + 1).alias("_d"),
                                   F.max(F.col("_depth").isNull()).alias("_wait"))
                              .where("NOT _wait").select(F.col("_m").alias("_a"), F.col("_d").alias("_depth")))
            if new.isEmpty():
                break
            solved = materialize(solved.unionByName(new))
    return (chains.join(solved, F.col("anchor") == F.col("_a"), "left")
            .select("call_id", (F.col("_depth") + F.col("far")).alias("depth")))


def problems(name: Column, args: Column, mark: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with the arguments (marked) of a call."""
    none = F.array().cast("array<string>")
    kind = F.schema_of_variant(args)
    keys = F.json_object_keys(F.to_json(args))
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, fields in sorted(schemas.items(), reverse=True):
        checks = []
        for field, (type_, required) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(args, f"$['{field}']", "variant"))
            text = F.when(got == "STRING", F.try_variant_get(args, f"$['{field}']", "string"))
            number = F.coalesce(text.startswith(F.concat(mark, F.lit(":"))), F.lit(False))
            value = F.replace(F.replace(text, F.concat(mark, F.lit(":")), F.lit("")), F.concat(F.lit(":"), mark), F.lit(""))
            if type_ == "number":
                fits = number
            elif type_ == "integer":
                behind = F.length(F.regexp_extract(value, r"\.([0-9]*)e", 1))
                fits = number & (value.rlike("^-?[0-9]+$") | (value.contains("e+") & (
                    behind <= F.coalesce(F.nullif(F.regexp_extract(value, r"e\+(.*)$", 1), F.lit("")).cast("long"), F.lit(0)))))
            else:
                fits = got.rlike(_TYPES[type_]) & ~number
            absent = got.isNull() if not required else F.lit(False)
            checks.append(F.when(~absent & got.isNull(), F.lit(f"missing {field}"))
                          .when(~absent & ~fits, F.lit(f"type of {field}")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(
            *[F.lit(f) for f in sorted(fields)]).cast("array<string>"))), lambda k: F.concat(F.lit("extra "), k))
        out = F.when(name == tool, F.concat(F.array_compact(F.array(*checks).cast("array<string>")),
                                            F.coalesce(extra, none))).otherwise(out)
    return F.array_sort(F.when(args.isNull() | ~kind.rlike("^OBJECT"), F.array(F.lit("malformed"))).otherwise(out))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """``calls`` with depth, valid, errors, result, n_results and the canonical
    JSON of the linked call."""
    nodes = materialize(calls.where("call_id is not null").select("call_id", "after").distinct())
    order = depths(nodes).withColumnsRenamed({"call_id": "_call"})
    each = (results.where("call_id is not null").groupBy(F.col("call_id").alias("_result_call"), F.col("content").alias("_result"))
            .agg(F.count(F.lit(1)).alias("_n")))
    known = nodes.select(F.col("call_id").alias("_after")).distinct()
    d = (calls.withColumn("_mark", F.md5(F.coalesce("arguments", F.lit(""))))
         .withColumn("_args", marked_arguments(F.col("arguments"), F.col("_mark")))
         .join(each.hint("shuffle_hash"), F.col("call_id") == F.col("_result_call"), "left")
         .join(order, F.col("call_id") == F.col("_call"), "left")
         .join(known, F.col("after") == F.col("_after"), "left"))
    wrong = F.array_compact(F.concat(
        problems(F.col("name"), F.col("_args"), F.col("_mark"), schemas),
        F.array(F.when(F.col("after").isNotNull() & F.col("_after").isNull(), F.lit("unknown after")),
                F.when(F.col("_call").isNotNull() & F.col("depth").isNull(), F.lit("cycle")))))
    is_object = F.schema_of_variant("_args").rlike("^OBJECT")
    d = d.select(*[F.col(f"`{c}`") for c in calls.columns], "depth", wrong.alias("errors"),
                 F.col("_result").alias("result"), F.coalesce("_n", F.lit(0)).alias("n_results"),
                 F.when(is_object, F.col("_args")).alias("_args"), "_mark")
    text = F.to_json(F.struct(
        F.col("after"), F.col("_args").alias("arguments"), F.col("call_id"), F.col("depth"), F.col("errors"),
        F.col("name"), F.col("result"), (F.size("errors") == 0).alias("valid")), {"ignoreNullFields": "false"})
    return (d.withColumn("valid", F.size("errors") == 0).withColumn("json", unmarked(text, F.col("_mark")))
            .drop("_args", "_mark"))


#: Argument schemas of the calls that ``derive`` makes.
TOOLS: Schemas = {
    "open": {"role": ("string", True), "text": ("string", True)},
    "search": {"query": ("string", True), "limit": ("integer", True), "filter": ("object", False)},
    "note": {"text": ("string", True), "tags": ("array", False), "pinned": ("boolean", False)},
    "score": {"text": ("string", True), "weight": ("number", True)},
}


def derive(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations, which hold none.  Every
    assistant turn is a call whose arguments hold its whole text, the user turn
    directly after it the result.  Every other turn (system, the opening user
    turn, a second user turn) is an ``open`` call with its role and text.  A
    call uses the result of an ``open`` directly before it, otherwise of the call
    two turns earlier.  The arguments of some turns break their schema, by a
    wrong type beside or around the text.  A turn without conversation or number
    links to no other."""
    def ident(*parts):
        return F.concat(F.lit("call_"), F.left(F.md5(F.concat_ws(":", *parts)), F.lit(20)))

    def near(back):  # NULL without conversation or number
        return F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), ident(F.col("conv_id"), F.col("turn") - back))

    alone = ident(F.lit("alone"), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in ("conv_id", "turn", "role")], "text")
    c = (conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
         .withColumns({"call_id": F.coalesce(near(0), alone), "_back": near(1)}))
    assistant = F.col("role").eqNullSafe("assistant")
    asked = c.where(assistant).select(F.col("call_id").alias("_asked")).distinct()
    rest = c.where(~assistant).join(asked, F.col("_back") == F.col("_asked"), "left")
    answer = F.col("role").eqNullSafe("user") & F.col("_asked").isNotNull()
    results = rest.where(answer).select(F.col("_back").alias("call_id"), F.col("text").alias("content"))
    opening = rest.where(~answer).drop("_asked")
    opened = opening.select(F.col("call_id").alias("_opened")).distinct()

    n = F.length("text")
    quoted = F.to_json(F.array("text"))
    string = quoted.substr(F.lit(2), F.length(quoted) - 2)
    args = (F.when(~assistant, F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), "text")))
        .when(F.col("turn") % 3 == 0, F.concat(
            F.lit('{ "query": '), string, F.lit(', "limit": '), F.when(n % 7 == 0, F.concat(F.lit('"'), n, F.lit('"')))
            .otherwise((n % 50).cast("string")), F.lit(', "filter": {"z": 1, "a": [true, null]} }')))
        .when(F.col("turn") % 3 == 1, F.concat(
            F.lit('{"text":'), string, F.lit(',"tags":["t'), (n % 5).cast("string"), F.lit('"], "pinned":'),
            F.when(n % 11 == 0, F.lit("1")).otherwise(F.lit("true")), F.lit("}")))
        .otherwise(F.concat(F.lit('{"weight": '), (n % 9).cast("string"), F.lit('.25, "text": '),
                            F.when(n % 5 == 0, quoted).otherwise(string), F.lit(" }"))))
    name = (F.when(~assistant, "open").when(F.col("turn") % 3 == 0, "search").when(F.col("turn") % 3 == 1, "note")
            .otherwise("score"))
    after = F.coalesce("_opened", F.when(F.col("turn") >= 2, near(2)))
    calls = (c.where(assistant).unionByName(opening).join(opened, F.col("_back") == F.col("_opened"), "left")
             .select("call_id", "conv_id", "turn", name.alias("name"), args.alias("arguments"), after.alias("after")))
    return calls, results


#: DuckDB SQL for the query over ``conversations`` whose (conv_id, turn) differ and are not NULL.
SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         'call_' || left(md5(concat_ws(':', conv_id, turn)), 20) AS id,
         'call_' || left(md5(concat_ws(':', conv_id, turn - 1)), 20) AS back_id,
         'call_' || left(md5(concat_ws(':', conv_id, turn - 2)), 20) AS two_id,
         role IS NOT DISTINCT FROM 'assistant' AS assistant FROM conversations),
kinds AS (
  SELECT t.*, coalesce(t.role = 'user', false) AND a.id IS NOT NULL AND NOT t.assistant AS answer
  FROM turns t LEFT JOIN (SELECT id FROM turns WHERE assistant) a ON t.back_id = a.id),
calls AS (
  SELECT k.conv_id, k.turn, k.id AS call_id, k.text, k.n, k.role, k.assistant,
         coalesce(o.id, CASE WHEN k.turn >= 2 THEN k.two_id END) AS after,
         CASE WHEN NOT k.assistant THEN 'open' WHEN k.turn % 3 = 0 THEN 'search' WHEN k.turn % 3 = 1 THEN 'note'
              ELSE 'score' END AS name
  FROM kinds k LEFT JOIN (SELECT id FROM kinds WHERE NOT assistant AND NOT answer) o ON k.back_id = o.id
  WHERE NOT k.answer),
results AS (
  SELECT back_id AS call_id, text AS content, count(*) AS n_results FROM kinds WHERE answer GROUP BY ALL),
steps AS (
  SELECT c.call_id, 0 AS depth FROM calls c LEFT JOIN calls p ON c.after = p.call_id WHERE p.call_id IS NULL
  UNION ALL SELECT c.call_id, s.depth + 1 FROM calls c JOIN steps s ON c.after = s.call_id),
checked AS (
  SELECT c.*, s.depth, r.content, coalesce(r.n_results, 0) AS n_results,
         list_filter([CASE WHEN name = 'search' AND n % 7 = 0 THEN 'type of limit'
                           WHEN name = 'note' AND n % 11 = 0 THEN 'type of pinned'
                           WHEN name = 'score' AND n % 5 = 0 THEN 'type of text' END,
                      CASE WHEN c.after IS NOT NULL AND p.call_id IS NULL THEN 'unknown after' END],
                     lambda e: e IS NOT NULL) AS errors,
         CASE name
           WHEN 'open' THEN '{"role":' || to_json(coalesce(role, '')) || ',"text":' || to_json(text) || '}'
           WHEN 'search' THEN '{"filter":{"a":[true,null],"z":1},"limit":'
             || CASE WHEN n % 7 = 0 THEN '"' || n || '"' ELSE CAST(n % 50 AS VARCHAR) END
             || ',"query":' || to_json(text) || '}'
           WHEN 'note' THEN '{"pinned":' || CASE WHEN n % 11 = 0 THEN '1' ELSE 'true' END || ',"tags":["t' || (n % 5)
             || '"],"text":' || to_json(text) || '}'
           ELSE '{"text":' || CASE WHEN n % 5 = 0 THEN '[' || to_json(text) || ']' ELSE to_json(text) END
             || ',"weight":' || (n % 9) || '.25}' END AS arguments
  FROM calls c JOIN steps s ON c.call_id = s.call_id
  LEFT JOIN (SELECT call_id FROM calls) p ON c.after = p.call_id LEFT JOIN results r ON c.call_id = r.call_id)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, turn, call_id, name, len(errors) = 0 AS valid,
       array_to_string(errors, ',') AS errors, n_results,
       '{"after":' || coalesce(CAST(to_json(after) AS VARCHAR), 'null') || ',"arguments":' || arguments
       || ',"call_id":' || to_json(call_id) || ',"depth":' || depth || ',"errors":' || to_json(errors)
       || ',"name":' || to_json(name) || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null')
       || ',"valid":' || CASE WHEN len(errors) = 0 THEN 'true' ELSE 'false' END || '}' AS json
FROM checked
"""
