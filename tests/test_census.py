"""Definitions' lexers and features, and the complexity of objects."""

import re

from profileloom.operators import census as N
from profileloom.operators import complexity as X
from profileloom.operators import objects as O

DEFINITIONS = "key string, dialect string, text string, applicable boolean, token string, place int, features string"


def census(spark, *texts, dialect="plpgsql"):
    rows = [(str(k), dialect, t, None, "x", 1, "y") for k, t in enumerate(texts)]
    return [r for r in sorted(N.language_census(spark.createDataFrame(rows, DEFINITIONS)).collect(), key=lambda r: int(r.key))]


def test_nothing_comes_from_comments_literals_and_names():
    hidden = "JOIN DELETE IF"
    for dialect, text in {
        "plpgsql": f"a /* {hidden} /* {hidden} */ {hidden} */ b -- {hidden}\n'{hidden} '' {hidden}' \"{hidden} \"\" {hidden}\" $q$ {hidden} $x$ ' $q$ $$ {hidden} $$ E'\\' {hidden}' c",
        "plsql": f"a q'[{hidden} ' ]' Q'!{hidden}!' nq'({hidden})' '{hidden}' b /* {hidden} */ c",
        "mysql-sql-psm": f"a # {hidden}\n`{hidden} `` {hidden}` '{hidden} \\' {hidden}' b c",
        "tsql": f"a [{hidden} ]] {hidden}] '{hidden}' b \"{hidden}\" c",
    }.items():
        assert N.lex(text, dialect) == ["IDENT"] * 3, dialect
    for open_ in ("/* JOIN", "/* /* */ JOIN", "'JOIN", '"JOIN', "-- JOIN", "$a$ JOIN $$"):
        assert N.lex("SELECT " + open_, "plpgsql") == ["SELECT"]
    assert N.lex("[JOIN] `JOIN`", "plpgsql") == ["JOIN"] * 2  # marks of other dialects
    assert N.lex("st_area(1) 2x %TYPE;", "tsql") == ["ST_", "(", "NUMBER", ")", "IDENT", "%", "TYPE", ";"]
    assert N.lex("", "tsql") == [] and N.lex("é", "tsql") == []


def test_long_definitions_are_lexed_in_linear_time():
    assert len(N.lex("SELECT 'x''y' /* a /* b */ */ " * 20_000, "plpgsql")) == 20_000
    assert N.lex("/*" * 100_000, "tsql") == [] and N.lex("'" + "''" * 100_000, "plsql") == []


def test_features(spark):
    texts = {
        "WITH a AS (SELECT 1), b AS (SELECT 2) SELECT * FROM a JOIN b": {"query.cte": "1", "data.select": "2-4", "query.subquery": "2-4", "query.join": "1"},
        "WITH RECURSIVE r AS (SELECT 1) SELECT 2": {"query.cte": "1", "query.recursive": "1", "data.select": "2-4", "query.subquery": "1"},
        "CREATE PROCEDURE p WITH EXECUTE AS OWNER AS BEGIN EXEC (@x); EXEC p; END": {"security.impersonation": "1", "dynamic.sql": "1", "state.ddl": "1"},
        "CREATE VIEW v WITH SCHEMABINDING AS (SELECT 1)": {"state.ddl": "1", "data.select": "1"},
        "CREATE TRIGGER t AFTER INSERT OR UPDATE OR DELETE ON x BEGIN DELETE FROM y; INSERT INTO z; END": {"state.ddl": "1", "data.delete": "1", "data.insert": "1"},
        "CREATE TRIGGER t INSTEAD OF INSERT ON x EXECUTE FUNCTION f()": {"state.ddl": "1"},
        "UPDATE a; SELECT 1 WHERE x OR UPDATE": {"data.update": "2-4", "data.select": "1"},
        "a TIMESTAMP WITH LOCAL TIME ZONE, b TIMESTAMP WITH TIME ZONE, c x AT TIME ZONE 'z', d TIMESTAMPTZ": {"type.timezone": "2-4"},
        "c VARCHAR(MAX), d VARCHAR(20), e BLOB, f t%ROWTYPE, g t.x%TYPE, h REF CURSOR": {"type.lob": "2-4", "query.aggregate": "1", "binding.percent_rowtype": "1", "binding.percent_type": "1", "interface.ref_cursor": "1", "interface.cursor": "1"},
        "START TRANSACTION; COMMIT; BEGIN TRAN; ROLLBACK; BEGIN; SAVEPOINT s": {"transaction.control": "5-8"},
        "SELECT max(x) OVER (ORDER BY y) FROM t GROUP BY z UNION SELECT 1 LIMIT 3": {"data.select": "2-4", "query.subquery": "1", "query.aggregate": "1", "query.window": "1", "query.order_by": "1", "query.group_by": "1", "query.set_operation": "1", "query.limit": "1"},
        "": {},
    }
    for text, r in zip(texts, census(spark, *texts), strict=True):
        assert r.status == "partial" and r.features == texts[text] and r.n_features == len(texts[text]), text
    empty = census(spark, *texts)[-1]
    assert (empty.size_band, empty.statements_band, empty.tokens_band, empty.complexity_band, empty.opacity_band) == ("0", "1", "0", "1", "0")


def test_nesting_and_branches(spark):
    text = "BEGIN IF a THEN LOOP CASE WHEN (b) THEN x; END CASE; END LOOP; END IF; END; END; ) ) IF c THEN y; END IF;"
    deep = {d: census(spark, text, dialect=d)[0] for d in N.DIALECTS}
    rows = {d: N.token_measures(N.sql_tokens(spark.createDataFrame([("k", d, text, None, "x", 1, "y")], DEFINITIONS))).first() for d in N.DIALECTS}
    assert {d: r.nesting for d, r in rows.items()} == {"plpgsql": 5, "plsql": 5, "mysql-sql-psm": 5, "tsql": 4}
    assert all(r.branches == 3 and r.statements == 8 for r in rows.values())
    assert all(r.complexity_band == "2-4" and r.complexity == 4 for r in deep.values())


def test_states_of_definitions(spark):
    rows = [("1", "plpgsql", "SELECT 1", True), ("2", "plpgsql", None, None), ("3", "cobol", "SELECT 1", None), ("4", None, "SELECT 1", None), ("5", "plsql", "CREATE PROCEDURE p WRAPPED a000 1 b", None), ("6", "plsql", "CREATE PROCEDURE p IS wrapped int; BEGIN x; END", None), ("7", "tsql", None, False), ("8", "tsql", "WRAPPED", None)]
    got = {r.key: (r.status, r.size_band, r.n_features) for r in N.language_census(spark.createDataFrame(rows, "key string, dialect string, text string, applicable boolean")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": "partial", "2": "unavailable", "3": "unavailable", "4": "unavailable", "5": "unavailable", "6": "partial", "7": "not_applicable", "8": "partial"}
    assert all((v[1] is None) == (v[2] is None) == (v[0] != "partial") for v in got.values())
    assert N.language_census(spark.createDataFrame([], DEFINITIONS)).collect() == []


def test_vocabulary_has_whole_words():
    assert all(re.fullmatch(r"[A-Z_#]+|[();%]", w) for w in N.VOCABULARY)


def test_object_graph(spark):
    objects = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 7, None, 1)], "object_id int")
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, None), (1, None), (4, 5), (5, 4), (6, 4), (7, 7), (3, 99), (None, 1)], "object_id int, target_id int")
    got = {r.object_id: (r.fan_out, r.unresolved, r.fan_in, r.depth) for r in X.object_graph(objects, edges).collect()}
    assert got == {1: (1, 2, 0, 2), 2: (1, 0, 1, 1), 3: (1, 0, 1, 0), 4: (1, 0, 2, None), 5: (1, 0, 1, None), 6: (1, 0, 0, None), 7: (1, 0, 1, None)}
    assert X.object_graph(objects.where("false"), edges).collect() == []


def test_assessment(spark):
    objects = spark.createDataFrame([("a", None, None, "available", "complete", True), ("b", True, None, "available", "complete", None), ("c", None, True, "available", "complete", None), ("d", None, None, "not_applicable", "not_applicable", None), ("e", None, None, None, None, None), ("f", False, False, "available", "partial", False), (None, None, None, None, None, None)], "object_id string, generated boolean, secondary boolean, visibility string, requirement_status string, external boolean")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", None), ("a", None), ("z", "a")], "object_id string, target_id string")
    needs = spark.createDataFrame([("a", "external.file"), ("a", "external.mail"), ("a", "plpgsql.x"), ("f", "external.y")], "object_id string, token string")
    census_ = spark.createDataFrame([("a", "partial", 300, 40, 0, 3), ("f", "unavailable", None, None, None, None)], "key string, status string, size long, complexity long, opacity long, n_features long")
    got = {(r.object_id, r.dimension): (r.state, r.bucket) for r in X.assess_objects(objects, edges, needs, census_).collect()}
    assert len(got) == 4 * 7
    assert {d: got["a", d] for d in X.DIMENSIONS} == {"volume": ("assessed", 2), "control-flow": ("assessed", 6), "feature-breadth": ("assessed", 2), "entanglement": ("assessed", 2), "environment-coupling": ("assessed", 2), "opacity": ("assessed", 0), "dialect-coupling": ("assessed", 1)}
    assert all(got["d", d] == (("assessed", 0) if d == "entanglement" else ("not-applicable", None)) for d in X.DIMENSIONS)
    assert all(got[k, d] == (("assessed", 0) if d == "entanglement" else ("unknown", None)) for d in X.DIMENSIONS for k in "ef")
    hidden = X.assess_objects(objects, edges, needs, census_, dependencies_complete=False)
    assert {r.state for r in hidden.where("dimension = 'entanglement'").collect()} == {"unknown"}
    # e and f are only seen in the graph: without it, nothing is known of them
    assert O.complexity_overall(hidden).first().unassessed == 2
    assert O.complexity_overall(X.assess_objects(objects, edges, needs, census_)).first().overall_band == "very-high"
    assert X.assess_objects(objects.where("false"), edges, needs, census_).collect() == []


def test_measures_sort_once_and_hold_no_lists(spark, capsys):
    tokens = N.sql_tokens(spark.createDataFrame([("k", "tsql", "CREATE TRIGGER t ON x AFTER INSERT OR UPDATE AS BEGIN WITH q AS (SELECT 1) DELETE FROM x END", None)], "key string, dialect string, text string, applicable boolean"))
    out = N.token_measures(tokens)
    got = out.first().features
    assert got["query.cte"] == 1 and got["data.delete"] == 1 and "data.insert" not in got and "data.update" not in got
    out.explain()
    shown = capsys.readouterr().out
    assert "collect_list" not in shown and shown.count("Sort [") == 1
