"""The tokenizer and the graph of a table as functions in SQL.

    register_functions(spark)
    spark.sql("SELECT tokenize(text) FROM documents")
    spark.sql("SELECT t.id, n.* FROM tables t, LATERAL table_nodes(gid, columns, rows, questions) n")

All are SQL expressions, which Spark puts in the place of the call, so there is no Python worker.
Each table function is a single generator over one expression; Spark runs a lateral call of such
a function on the row at hand, while one of two generators would become a join.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridweave.functions.text import STRIPPED, TRAILING, WHITESPACE
from gridweave.schemas import NULL_WORD, SEPARATOR


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _tokenize(text: str) -> str:
    """As `functions.text.tokenize`, on the SQL expression `text`."""
    null_word = f"array({_quoted(NULL_WORD)})"
    trailing = ", ".join(map(_quoted, TRAILING))
    blanked = f"""replace(replace({text}, {_quoted(SEPARATOR)}, ' '), {_quoted('\\"')}, ' ')"""
    pieces = f"filter(split({blanked}, {_quoted(WHITESPACE)}), piece -> piece <> '')"
    peeled = f"""transform({pieces}, piece -> struct(
        startswith(piece, '(') AS bracket,
        btrim(regexp_replace(piece, {_quoted('^\\(')}, ''), {_quoted(STRIPPED)}) AS body))"""
    words = f"""CASE
        WHEN p.body = '' THEN {null_word}
        WHEN length(p.body) >= 2 AND right(p.body, 1) IN ({trailing})
          THEN array(left(p.body, length(p.body) - 1), right(p.body, 1))
        ELSE array(p.body) END"""
    return f"""CASE WHEN {text} IS NULL THEN {null_word} ELSE flatten(transform({peeled},
        p -> concat(CASE WHEN p.bracket THEN array('(') ELSE array() END, {words}))) END"""


def _node(row: str, col: str, type: str, text: str) -> str:
    return (
        f"named_struct('row', int({row}), 'col', int({col}), 'type', '{type}', 'text', {text})"
    )


_TABLE = (
    "graph BIGINT, headers ARRAY<STRING>, body ARRAY<ARRAY<STRING>>, asked ARRAY<STRING>"
)

_NODES = f"""concat(
    array({_node("0", "0", "VH", "'[VH]'")}),
    transform(headers, (text, c) -> {_node("0", "c + 1", "H", "text")}),
    flatten(transform(body, (cells, r) -> concat(
        array({_node("r + 1", "0", "VE", "'[VE]'")}),
        transform(cells, (text, c) -> {_node("r + 1", "c + 1", "Cell", "text")})))),
    array({_node("size(body) + 1", "0", "Caption", f"array_join(asked, {_quoted(SEPARATOR)})")}))"""


def _link(a: tuple[str, str], b: tuple[str, str], types: tuple[str, str]) -> str:
    """Both directions of a link between the nodes at (row, column) `a` and `b`, as numbers: text
    is made after the call's generator, where it is compiled."""
    return "array({}, {})".format(
        *(
            f"named_struct('sr', int({s[0]}), 'sc', int({s[1]}), 'dr', int({d[0]}), 'dc', int({d[1]}), 'type', '{x}-{y}')"
            for s, d, x, y in ((a, b, *types), (b, a, *reversed(types)))
        )
    )


def _at(row: str, col: str) -> str:
    return f"concat_ws('-', graph, {row}, {col})"


_HUB, _BELOW = ("0", "0"), ("size(body) + 1", "0")
_WIDTH = "CASE WHEN dangling THEN size(headers) ELSE least(size(headers), size(cells)) END"

_LINKS = f"""concat(
    transform(headers, (text, c) -> {_link(_HUB, ("0", "c + 1"), ("VH", "H"))}),
    flatten(transform(body, (cells, r) -> concat(
        array({_link(_BELOW, ("r + 1", "0"), ("Caption", "VE"))}),
        transform(cells, (text, c) -> {_link(("r + 1", "0"), ("r + 1", "c + 1"), ("VE", "Cell"))}),
        transform(slice(headers, 1, {_WIDTH}),
                  (text, c) -> {_link(("0", "c + 1"), ("r + 1", "c + 1"), ("H", "Cell"))})))),
    array({_link(_BELOW, _HUB, ("Caption", "VH"))}))"""

FUNCTIONS = [
    f"tokenize(words_of STRING) RETURNS ARRAY<STRING> RETURN {_tokenize('words_of')}",
    f"""text_words(words_of STRING) RETURNS TABLE (place INT, word STRING)
    RETURN SELECT * FROM posexplode({_tokenize('words_of')})""",
    f"""table_nodes({_TABLE})
    RETURNS TABLE (gid BIGINT, row INT, col INT, pos INT, id STRING, type STRING, text STRING)
    RETURN SELECT graph, node.row, node.col, pos, {_at("node.row", "node.col")}, node.type, node.text
    FROM (SELECT posexplode({_NODES}) AS (pos, node))""",
    f"""table_edges({_TABLE}, dangling BOOLEAN DEFAULT true)
    RETURNS TABLE (gid BIGINT, src STRING, dst STRING, type STRING)
    RETURN SELECT graph, {_at("sr", "sc")}, {_at("dr", "dc")}, type
    FROM (SELECT inline(flatten({_LINKS})))""",
]


def register_functions(spark: SparkSession) -> None:
    """Make the functions known to the session, in the place of earlier ones of these names.

    * `tokenize(text)`: the words as an array; `text_words(text)`: a row for each word.
    * `table_nodes(gid, columns, rows, questions)`: the nodes of a table, as `table_nodes` in
      Python gives them.
    * `table_edges(gid, columns, rows, questions[, dangling])`: its edges in both directions,
      without the positions of the ends.
    """
    for function in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}")
