"""Census of SQL definitions: a lexer for each dialect, and features counted from its tokens.

Texts never leave the lexer: what it gives are words of a closed vocabulary, so no name, literal or comment can show. Everything after it is
joins and windows over (key, place, token).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.functions.tokens import byte_band, count_band

#: Dialects that the lexer knows.
DIALECTS = ("plpgsql", "plsql", "mysql-sql-psm", "tsql")
#: Features by the words that show them.
WORD_FEATURES = {
    "control.case": ("CASE",),
    "control.exception": ("EXCEPTION", "CATCH", "HANDLER"),
    "control.goto": ("GOTO",),
    "control.if": ("IF",),
    "control.loop": ("LOOP",),
    "control.raise": ("RAISE", "THROW", "RAISERROR", "SIGNAL", "RESIGNAL"),
    "control.repeat": ("REPEAT",),
    "control.while": ("WHILE",),
    "data.merge": ("MERGE",),
    "data.select": ("SELECT",),
    "interface.cursor": ("CURSOR",),
    "query.aggregate": ("COUNT", "SUM", "AVG", "MIN", "MAX"),
    "query.join": ("JOIN",),
    "query.limit": ("LIMIT", "TOP", "FETCH"),
    "query.recursive": ("RECURSIVE",),
    "query.set_operation": ("UNION", "INTERSECT", "EXCEPT"),
    "query.window": ("OVER",),
    "security.definer": ("DEFINER",),
    "security.invoker": ("INVOKER",),
    "state.ddl": ("CREATE", "ALTER", "DROP", "TRUNCATE"),
    "state.temporary": ("TEMP", "TEMPORARY", "#TEMP"),
    "type.boolean": ("BOOLEAN", "BOOL", "BIT"),
    "type.interval": ("INTERVAL",),
    "type.json": ("JSON", "JSONB", "JSON_VALUE", "JSON_QUERY"),
    "type.spatial": ("GEOMETRY", "GEOGRAPHY", "ST_"),
    "type.vector": ("VECTOR",),
    "type.xml": ("XML",),
}
#: Features by sequences of words; one of a single word counts by itself.
SEQUENCE_FEATURES = {
    "binding.percent_rowtype": ("% ROWTYPE",),
    "binding.percent_type": ("% TYPE",),
    "interface.ref_cursor": ("REFCURSOR", "SYS_REFCURSOR", "REF CURSOR"),
    "query.group_by": ("GROUP BY",),
    "query.order_by": ("ORDER BY",),
    "security.impersonation": ("EXECUTE AS",),
    "transaction.control": ("COMMIT", "ROLLBACK", "SAVEPOINT", "START TRANSACTION", "BEGIN TRANSACTION", "BEGIN TRAN"),
    "type.lob": ("BLOB", "CLOB", "NCLOB", "BYTEA", "IMAGE", "VARBINARY ( MAX )", "VARCHAR ( MAX )", "NVARCHAR ( MAX )"),
    "type.timezone": ("TIMESTAMPTZ", "DATETIMEOFFSET", "AT TIME ZONE", "TIMESTAMP WITH TIME ZONE", "TIMESTAMP WITH LOCAL TIME ZONE"),
}
#: Words that change rows, unless they name the event of a trigger; words that open a block in a dialect besides BEGIN, CASE and LOOP; words that branch.
CHANGES = {"data.delete": "DELETE", "data.insert": "INSERT", "data.update": "UPDATE"}
OPENERS = {"plpgsql": ("IF",), "plsql": ("IF",), "mysql-sql-psm": ("IF", "WHILE", "REPEAT"), "tsql": ()}
BRANCHES = ("ELSIF", "ELSEIF", "WHEN", "WHILE", "CATCH", "HANDLER")
#: What may follow WITH without its being a common table expression, words between WITH and its AS (, and further words the rules need.
NOT_CTE, CTE_WORDS = ("SCHEMABINDING", "ENCRYPTION", "NATIVE_COMPILATION"), 10
OTHER_WORDS = ("AFTER", "AS", "BEFORE", "BEGIN", "BY", "ELSEIF", "ELSIF", "END", "EXEC", "EXECUTE", "FUNCTION", "GROUP", "INSTEAD", "IS", "OF", "OR", "PREPARE", "PROCEDURE", "SP_EXECUTESQL", "TRIGGER", "WITH", "WRAPPED")

VOCABULARY = {w for ws in (*WORD_FEATURES.values(), *(s.split() for x in SEQUENCE_FEATURES.values() for s in x), CHANGES.values(), BRANCHES, NOT_CTE, OTHER_WORDS) for w in ws}

_BLOCK = re.compile(r"/\*|\*/")
_COMMON = r"--[^\n]*|(?P<block>/\*)|\"(?:[^\"]|\"\")*(?:\"|\Z)"
_PLAIN, _ESCAPED = r"'(?:[^']|'')*(?:'|\Z)", r"'(?:[^'\\]|''|\\.)*(?:'|\Z)"
_DOLLAR = r"\$(?P<tag>[A-Za-z_][A-Za-z_0-9]*|)\$.*?(?:\$(?P=tag)\$|\Z)"
#: Literals, quoted names and comments of each dialect, each in one branch; then words and marks.
_SKIPPED = {
    "plpgsql": rf"(?<![A-Za-z0-9_])[eE]{_ESCAPED}|{_COMMON}|{_PLAIN}|(?<![A-Za-z0-9_]){_DOLLAR}",
    "plsql": rf"(?<![A-Za-z0-9_])[nN]?[qQ]'(?:\[.*?(?:\]'|\Z)|\{{.*?(?:\}}'|\Z)|\(.*?(?:\)'|\Z)|<.*?(?:>'|\Z)|(?P<mark>[^\s\[{{(<]).*?(?:(?P=mark)'|\Z))|{_COMMON}|{_PLAIN}",
    "mysql-sql-psm": rf"#[^\n]*|{_COMMON}|{_ESCAPED}|`(?:[^`]|``)*(?:`|\Z)",
    "tsql": rf"{_COMMON}|{_PLAIN}|\[(?:[^\]]|\]\])*(?:\]|\Z)",
}
_LEXERS = {d: re.compile(rf"(?P<skip>{s})|(?P<word>[A-Za-z0-9_#]+)|(?P<mark_>[();%])", re.S) for d, s in _SKIPPED.items()}


def lex(text: str, dialect: str) -> list[str]:
    """The words of a definition that are in the vocabulary, (, ), ; and %; others are IDENT, NUMBER or ST_. Comments nest; what isn't closed goes on to the end."""
    out, at, lexer = [], 0, _LEXERS[dialect]
    while found := lexer.search(text, at):
        at = found.end()
        if found["block"]:
            depth = 1
            while depth and (edge := _BLOCK.search(text, at)):
                depth, at = depth + (1 if edge[0] == "/*" else -1), edge.end()
            if depth:
                break
        elif word := found["word"]:
            word = word.upper()
            out.append(word if word in VOCABULARY else "ST_" if word.startswith("ST_") else "NUMBER" if word.isdigit() else "IDENT")
        elif found["mark_"]:
            out.append(found["mark_"])
    return out


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [lex(t, d) for t, d in zip(batch.column("text").to_pylist(), batch.column("dialect").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("dialect"), pa.array(words, pa.list_(pa.string()))], ["key", "dialect", "tokens"])


def sql_tokens(definitions: DataFrame) -> DataFrame:
    """(key, dialect, place, token) of definitions (key, dialect, text): places from 0. NULL texts and other dialects than DIALECTS have no rows; keys are taken to be distinct."""
    known = definitions.where(F.col("text").isNotNull() & F.col("dialect").isin(*DIALECTS))
    rows = known.select(F.col("key").cast("string").alias("key"), "dialect", F.col("text").cast("string").alias("text")).mapInArrow(_lexed, "key string, dialect string, tokens array<string>")
    return rows.select("key", "dialect", F.posexplode("tokens").alias("place", "token"))


def _is(token: Column, *words: str) -> Column:
    return F.coalesce(token.isin(*words), F.lit(False))


def token_measures(tokens: DataFrame) -> DataFrame:
    """(key, tokens, statements, nesting, branches, opaque, features map) of tokens (key, dialect, place, token), by windows over each definition.

    features has the count of each feature that occurs. statements are marks ;, one at least. nesting is the deepest of parentheses and blocks, closing what isn't
    open being nothing. opaque are places where SQL is made at run time. A SELECT alone is no subquery; a WITH is a common table
    expression if AS ( follows soon; INSERT, UPDATE and DELETE after BEFORE, AFTER, INSTEAD OF, or after OR in a trigger's head, are its events.
    """
    own = W.partitionBy("key").orderBy("place")
    t, after, before = F.col("token"), lambda k: F.lead("token", k).over(own), lambda k: F.lag("token", k).over(own)
    openers = F.lit(False)
    for d, ws in OPENERS.items():
        openers = openers | (_is(F.col("dialect"), d) & _is(t, *ws)) if ws else openers
    opens = (t == "(") | (~_is(before(1), "END") & (_is(t, "BEGIN", "CASE", "LOOP") | openers))
    # a statement ends with ; or BEGIN, so its head has had a TRIGGER if that is the last of these words
    mark = F.last(F.when(_is(t, ";", "BEGIN", "TRIGGER"), t), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    rows = tokens.select("key", "place", t, *(after(k).alias(f"a{k}") for k in range(1, 5)), before(1).alias("b1"), before(2).alias("b2"), opens.cast("int").alias("opens"), _is(t, ")", "END").cast("int").alias("closes"), _is(mark, "TRIGGER").alias("in_trigger"))
    # depth that never falls below nothing: the sum so far above its least so far; places of AS ( so far
    upto = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("sum", F.sum(F.col("opens") - F.col("closes")).over(upto)).withColumn("n_as", F.sum((_is(t, "AS") & _is(F.col("a1"), "(")).cast("int")).over(upto))
    # past the last word there are no more
    ahead, every = lambda k: F.lead("n_as", k).over(own), F.max("n_as").over(W.partitionBy("key"))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(upto), F.lit(0)))
    rows = rows.withColumn("as_1", ahead(1)).withColumn("as_near", F.coalesce(ahead(CTE_WORDS - 1), every)).withColumn("as_far", F.coalesce(ahead(CTE_WORDS), every))

    def sequence(text: str) -> Column:
        words = text.split()
        out = t == words[0]
        for k, w in enumerate(words[1:], 1):
            out = out & _is(F.col(f"a{k}") if k < 5 else F.lit(None), w)
        return out

    # the only sequence of five words starts with two of its own
    long_zone = _is(F.col("b1"), "TIMESTAMP") & sequence("WITH LOCAL TIME ZONE")
    event = _is(F.col("b1"), "BEFORE", "AFTER") | (_is(F.col("b1"), "OF") & _is(F.col("b2"), "INSTEAD")) | (_is(F.col("b1"), "OR") & F.col("in_trigger"))
    made = _is(t, "PREPARE", "SP_EXECUTESQL") | (_is(t, "EXECUTE") & ~_is(F.col("a1"), "FUNCTION", "PROCEDURE", "AS")) | (_is(t, "EXEC") & _is(F.col("a1"), "("))
    recursive = _is(F.col("a1"), "RECURSIVE")
    first, second = (F.when(recursive, F.col(f"a{k + 1}")).otherwise(F.col(f"a{k}")) for k in (1, 2))
    follows = F.when(recursive, F.col("as_far") > F.col("as_1")).otherwise(F.col("as_near") > F.col("n_as"))
    cte = (t == "WITH") & ~_is(first, *NOT_CTE) & ~(_is(first, "EXECUTE") & _is(second, "AS")) & F.coalesce(follows, F.lit(False))
    found = {f: _is(t, *ws) for f, ws in WORD_FEATURES.items()}
    for f, parts in SEQUENCE_FEATURES.items():
        hit = F.lit(False)
        for part in parts:
            hit = hit | (long_zone if len(part.split()) == 5 else sequence(part))
        found[f] = hit
    found |= {f: _is(t, w) & ~event for f, w in CHANGES.items()} | {"dynamic.sql": made, "query.cte": cte}
    branch = (_is(t, "IF") & ~_is(F.col("b1"), "END")) | _is(t, *BRANCHES)
    count = lambda x: F.count(F.when(x, 1))
    sums = rows.groupBy("key").agg(F.count("*").alias("tokens"), count(t == ";").alias("statements"), F.greatest(F.max("depth"), F.lit(0)).cast("long").alias("nesting"), count(branch).alias("branches"), count(made).alias("opaque"), *(count(x).alias(f) for f, x in found.items()))
    named = [F.struct(F.lit(f).alias("key"), F.col(f"`{f}`").alias("value")) for f in sorted(found)] + [F.struct(F.lit("query.subquery").alias("key"), F.greatest(F.col("`data.select`") - 1, F.lit(0)).alias("value"))]
    features = F.map_from_entries(F.filter(F.array(*named), lambda x: x["value"] > 0))
    return sums.select("key", "tokens", F.greatest("statements", F.lit(1)).alias("statements"), "nesting", "branches", "opaque", features.alias("features"))


def language_census(definitions: DataFrame) -> DataFrame:
    """A row for each of definitions (key, dialect, text, applicable): key, status, bands of size, statements, tokens, nesting, complexity and opacity, n_features, features (a map to bands), and the counts' buckets.

    status is not_applicable where `applicable` is false, unavailable for NULL texts, unknown dialects and wrapped source (plsql with WRAPPED before AS, IS or BEGIN); else
    partial, as a lexer sees no grammar. Only partial rows have bands. Empty texts have one statement and no tokens. NULL in applicable is true.
    """
    rows = definitions.select(F.col("key").cast("string").alias("key"), "dialect", "text", F.coalesce("applicable", F.lit(True)).alias("applicable"))
    tokens = sql_tokens(rows.where("applicable"))
    first = lambda *words: F.min(F.when(F.col("token").isin(*words), F.col("place")))
    wrapped = tokens.where("dialect = 'plsql'").groupBy("key").agg(first("WRAPPED").alias("w"), first("AS", "IS", "BEGIN").alias("b")).where("w < coalesce(b, w + 1)").select("key", F.lit(True).alias("wrapped"))
    both = rows.join(token_measures(tokens), "key", "left").join(wrapped, "key", "left")
    partial = F.col("applicable") & F.col("text").isNotNull() & F.col("dialect").isin(*DIALECTS) & F.col("wrapped").isNull()
    status = F.when(~F.col("applicable"), "not_applicable").when(F.coalesce(partial, F.lit(False)), "partial").otherwise("unavailable")
    n = lambda c, least=0: F.when(F.col("status") == "partial", F.coalesce(F.col(c), F.lit(least)))
    numbers = {"size": F.when(F.col("status") == "partial", F.octet_length("text")), "statements": n("statements", 1), "tokens": n("tokens"), "nesting": n("nesting"), "complexity": n("branches") + 1, "opacity": n("opaque"), "n_features": F.when(F.col("status") == "partial", F.coalesce(F.size("features"), F.lit(0)))}
    out = both.withColumn("status", status).select("key", "status", *(x.cast("long").alias(c) for c, x in numbers.items()), F.when(F.col("status") == "partial", F.coalesce("features", F.expr("map()").cast("map<string,bigint>"))).alias("features"))
    banded = lambda c: F.when(F.col(c).isNotNull(), (byte_band if c == "size" else count_band)(c))
    return out.select("key", "status", *(banded(c).alias(f"{c}_band") for c in numbers if c != "n_features"), "size", "complexity", "opacity", "n_features", F.transform_values("features", lambda _, v: count_band(v)).alias("features"))
