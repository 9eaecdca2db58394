"""Record schema, graph schema and the constants shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Message format of the table-and-question records (proto2).
# message -> (field, number, type); "*" marks a repeated field.
# ---------------------------------------------------------------------------
MESSAGES = {
    "Interaction": [
        ("id", 1, "string"),
        ("table", 2, "Table"),
        ("questions", 3, "Question*"),
    ],
    "Question": [
        ("id", 1, "string"),
        ("text", 2, "string"),
        ("original_text", 3, "string"),
        ("annotations", 4, "NumericValueSpans"),
        ("answer", 5, "Answer"),
        ("alternative_answers", 6, "Answer*"),
    ],
    "AnswerCoordinate": [("row_index", 1, "int32"), ("column_index", 2, "int32")],
    "Answer": [
        ("answer_coordinates", 1, "AnswerCoordinate*"),
        ("aggregation_function", 2, "AggregationFunction"),
        ("answer_texts", 3, "string*"),
        ("float_value", 4, "float"),
        ("is_valid", 5, "bool"),
        ("class_index", 6, "int32"),
    ],
    "Table": [
        ("columns", 1, "Cell*"),
        ("rows", 2, "Cells*"),
        ("table_id", 3, "string"),
        ("document_title", 4, "string"),
        ("caption", 5, "string"),
        ("document_url", 6, "string"),
        ("alternative_document_urls", 7, "string*"),
        ("alternative_table_ids", 8, "string*"),
        ("context_heading", 9, "string"),
    ],
    "Cell": [("text", 1, "string"), ("numeric_value", 2, "NumericValue")],
    "Cells": [("cells", 1, "Cell*")],
    "Date": [("year", 1, "int32"), ("month", 2, "int32"), ("day", 3, "int32")],
    "NumericValue": [("float_value", 1, "float"), ("date", 2, "Date")],
    "NumericValueSpan": [
        ("begin_index", 1, "int32"),
        ("end_index", 2, "int32"),
        ("values", 3, "NumericValue*"),
    ],
    "NumericValueSpans": [("spans", 1, "NumericValueSpan*")],
}
AGGREGATION_FUNCTIONS = ["NONE", "SUM", "AVERAGE", "COUNT"]
EXCLUSIVE_FIELDS = {"NumericValue"}  # at most one field of these messages is set

_SCALARS = {
    "string": T.StringType(),
    "int32": T.IntegerType(),
    "float": T.FloatType(),
    "bool": T.BooleanType(),
    "AggregationFunction": T.StringType(),
}


def _spark_type(kind: str) -> T.DataType:
    if kind.endswith("*"):
        return T.ArrayType(_spark_type(kind[:-1]))
    if kind in _SCALARS:
        return _SCALARS[kind]
    return T.StructType([T.StructField(f, _spark_type(k)) for f, _, k in MESSAGES[kind]])


INTERACTION_SCHEMA: T.StructType = _spark_type("Interaction")

# Tables reduced to the text the graph is built from, and the stored tables (as DDL).
TABLE_SCHEMA = (
    "id string, columns array<string>, rows array<array<string>>, questions array<string>"
)
NODE_SCHEMA = "gid long, row int, col int, pos int, id string, type string, text string"
EDGE_SCHEMA = "gid long, src string, dst string, type string, i int, j int"
DICTIONARY_SCHEMA = "word string, cnt long, word_id long"

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
TABLE_SIZE_LIMIT = 3000  # rows x columns, exclusive
UNK, MASK, PAD, EOS = 0, 1, 2, 3
SPECIAL_WORDS = ["[UNK]", "[MASK]", "[PAD]", "[EOS]"]  # ids 0..3
FIRST_WORD_ID = 4
MIN_WORD_COUNT = 3  # exclusive
SEQUENCE_LENGTH = 128
MASK_RATE = 0.1
REPLACE_RATE = 0.8
MASKED_TYPE = -1
UNSELECTED_LABEL = -1
WORD_VECTOR_SIZE = 100
LEAKY_SLOPE = 0.1
NULL_WORD = "-"
SEPARATOR = "[SEP]"
NODE_TYPES = ["VH", "H", "VE", "Cell", "Caption"]  # codes 0..4
RELATIONS = [  # channels 0..5
    ("VH", "H"),
    ("VH", "VE"),
    ("VE", "Cell"),
    ("VH", "Caption"),
    ("Caption", "VE"),
    ("Cell", "H"),
]
EDGE_KINDS = [  # undirected; both directions are stored
    ("VH", "H"),
    ("VE", "Cell"),
    ("Caption", "VH"),
    ("Caption", "VE"),
    ("H", "Cell"),
]
