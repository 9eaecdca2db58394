"""The registered queries once more, as SQL on the given tables."""

from __future__ import annotations

from gridweave.operators.permutation import FACTORS, Permutation
from gridweave.schemas import NODE_TYPES, RELATIONS, SEQUENCE_LENGTH
from workload.fixtures import COLUMNS, FEATURE_SIZE, HEAD_SIZE, MASKING

_SPACE = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"


# --- order tables and their graph -------------------------------------------

_TABLES = """
li AS (
  SELECT l_orderkey AS oid,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS r,
         [l_linenumber::VARCHAR, l_partkey::VARCHAR, l_quantity::BIGINT::VARCHAR, l_returnflag] AS cells
  FROM lineitem),
sizes AS (SELECT oid, count(*) AS n FROM li GROUP BY oid),
questions AS (
  SELECT conv_id AS oid, string_agg(text, '[SEP]' ORDER BY turn) AS caption
  FROM conversations WHERE role = 'user' GROUP BY conv_id),
t AS (
  SELECT o_orderkey AS oid, coalesce(n, 0) AS n, coalesce(caption, '') AS caption,
         row_number() OVER (ORDER BY o_orderkey) - 1 AS gid
  FROM orders LEFT JOIN sizes s ON s.oid = o_orderkey LEFT JOIN questions q ON q.oid = o_orderkey
  WHERE coalesce(n, 0) * 4 < 3000)
"""

_HEADER = ", ".join(f"({i + 1}, '{name}')" for i, name in enumerate(COLUMNS))

_NODES = f"""
bare AS (
  SELECT gid, 0 AS row, 0 AS col, 'VH' AS type, '[VH]' AS text FROM t
  UNION ALL SELECT gid, 0, c, 'H', name FROM t, (VALUES {_HEADER}) h(c, name)
  UNION ALL SELECT gid, r, 0, 'VE', '[VE]' FROM t JOIN li USING (oid)
  UNION ALL SELECT gid, r, c, 'Cell', cells[c] FROM t JOIN li USING (oid), (VALUES (1), (2), (3), (4)) h(c)
  UNION ALL SELECT gid, n + 1, 0, 'Caption', caption FROM t),
nodes AS (
  SELECT gid, row, col, row_number() OVER (PARTITION BY gid ORDER BY row, col) - 1 AS pos,
         concat(gid, '-', row, '-', col) AS id, type, text
  FROM bare)
"""

_EDGES = """
linked AS (
  SELECT a.gid, a.id AS a, b.id AS b, a.type AS ta, b.type AS tb
  FROM nodes a JOIN nodes b ON a.gid = b.gid
  WHERE (a.type = 'VH' AND b.type = 'H')
     OR (a.type = 'VE' AND b.type = 'Cell' AND a.row = b.row)
     OR (a.type = 'Caption' AND b.type IN ('VH', 'VE'))
     OR (a.type = 'H' AND b.type = 'Cell' AND a.col = b.col)),
edges AS (
  SELECT gid, a AS src, b AS dst, ta || '-' || tb AS type FROM linked
  UNION ALL SELECT gid, b, a, tb || '-' || ta FROM linked)
"""

_PAIR_LIST = ", ".join(f"({i}, ['{a}', '{b}'])" for i, (a, b) in enumerate(RELATIONS))
_CODE_LIST = ", ".join(f"'{name}'" for name in NODE_TYPES)

_CHANNELS = f"""
relations AS (SELECT * FROM (VALUES {_PAIR_LIST}) r(rel, ends)),
adjacent AS (
  SELECT gid, src, dst FROM edges UNION SELECT gid, id, id FROM nodes),
channels AS (
  SELECT e.gid, rel, src, dst
  FROM adjacent e JOIN nodes s ON s.gid = e.gid AND s.id = src JOIN nodes d ON d.gid = e.gid AND d.id = dst
  JOIN relations ON list_contains(ends, s.type) OR list_contains(ends, d.type))
"""


def _coin(label: str, id: str, rate: float) -> str:
    digest = f"md5('{MASKING.seed}/{label}|' || {id})"
    return f"(('0x' || substr({digest}, 1, 8))::BIGINT / 4294967296.0 < {rate})"


def _selected(id: str) -> str:
    return _coin("select", id, MASKING.rate)


def _replaced(id: str) -> str:
    return f"({_selected(id)} AND {_coin('replace', id, MASKING.replace)})"


_MASKED = f"""
hidden AS (SELECT gid, id FROM nodes WHERE {_replaced('id')}),
masked_channels AS (
  SELECT c.gid, r.rel, c.src, c.dst
  FROM (SELECT DISTINCT gid, src, dst FROM channels) c, relations r
  WHERE src IN (SELECT id FROM hidden) OR dst IN (SELECT id FROM hidden))
"""


# --- text -------------------------------------------------------------------


def _words(text: str) -> str:
    """The words of the string expression `text`, as a list."""
    blanked = f"replace(replace({text}, '[SEP]', ' '), '\\\"', ' ')"
    pieces = f"list_filter(string_split_regex({blanked}, '{_SPACE}'), lambda p: p <> '')"
    bodies = (
        f"list_transform({pieces}, lambda p: {{'open': starts_with(p, '('), "
        "'body': trim(CASE WHEN starts_with(p, '(') THEN substr(p, 2) ELSE p END, '\"\\''')})"
    )
    tail = "right(b.body, 1)"
    words = (
        "CASE WHEN b.body = '' THEN ['-'] "
        f"WHEN length(b.body) >= 2 AND {tail} IN (',', '.', '!', '?', ')', ':', ';') "
        f"THEN [left(b.body, length(b.body) - 1), {tail}] ELSE [b.body] END"
    )
    listed = f"list_transform({bodies}, lambda b: CASE WHEN b.open THEN ['('] ELSE [] END || {words})"
    return f"CASE WHEN {text} IS NULL THEN ['-'] ELSE flatten({listed}) END"


def _counts(source: str, text: str = "text", name: str = "counts") -> str:
    return f"""
{name} AS (
  SELECT word, count(*) AS cnt
  FROM (SELECT unnest({_words(text)}) AS word FROM {source}) GROUP BY word)
"""


_DICTIONARY = """
dictionary AS (
  SELECT word, 0::BIGINT AS cnt, word_id
  FROM (VALUES ('[UNK]', 0), ('[MASK]', 1), ('[PAD]', 2), ('[EOS]', 3)) s(word, word_id)
  UNION ALL
  SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) + 3
  FROM counts WHERE cnt > 3 AND word NOT IN ('[UNK]', '[MASK]', '[PAD]', '[EOS]'))
"""


def _ids(source: str, key: str, text: str = "text") -> str:
    """ids(key, ids): unpadded ids of the words of each text."""
    return f"""
listed AS (SELECT {key}, {_words(text)} AS w FROM {source}),
placed AS (SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM listed),
found AS (
  SELECT {key}, list(coalesce(word_id, 0) ORDER BY place) AS ids
  FROM placed LEFT JOIN dictionary USING (word) GROUP BY {key}),
ids AS (SELECT {key}, coalesce(ids, []) AS ids FROM listed LEFT JOIN found USING ({key})),
padded AS (
  SELECT {key}, CASE WHEN len(ids) >= {SEQUENCE_LENGTH} THEN ids[1:{SEQUENCE_LENGTH}]
    ELSE (ids || [3]) || list_transform(range({SEQUENCE_LENGTH} - 1 - len(ids)), lambda x: 2) END AS ids
  FROM ids)
"""


_DOC_WORDS = _counts("documents")
_TEXTS = "texts AS (SELECT DISTINCT text FROM nodes)"
_GRAPH_DICTIONARY = _counts("nodes") + "," + _DICTIONARY


# --- skip-gram training -----------------------------------------------------


def _draw(seed: str, key: str, digits: int = 8) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {key})), 1, {digits}))::BIGINT"


_KEPT = f"""
ordinary AS (SELECT *, sum(cnt) OVER () AS total FROM dictionary WHERE word_id > 3),
keeps AS (
  SELECT word, word_id,
    floor(least(1.0::DOUBLE, sqrt(0.001::DOUBLE * total::DOUBLE / cnt::DOUBLE)) * 4294967296::DOUBLE)::BIGINT AS keep
  FROM ordinary),
spoken AS (SELECT doc_id, {_words('text')} AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM spoken),
kept AS (
  SELECT doc_id, pos, word_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place
  FROM placed JOIN keeps USING (word) WHERE {_draw('pairs/keep', 'doc_id, pos')} < keep)
"""

_ALIAS = """
weights AS (
  SELECT word_id, floor(1000 * q * q * q + 0.5)::HUGEINT AS weight
  FROM (SELECT word_id, sqrt(sqrt(cnt::DOUBLE)) AS q FROM dictionary WHERE word_id > 3)),
slots AS (
  SELECT word_id, row_number() OVER (ORDER BY word_id) - 1 AS slot, sum(weight) OVER () AS total,
    weight * count(*) OVER () - sum(weight) OVER () AS excess
  FROM weights),
light AS (
  SELECT *, sum(-excess) OVER (ORDER BY word_id) AS until, sum(-excess) OVER (ORDER BY word_id) + excess AS start
  FROM slots WHERE excess < 0),
heavy AS (
  SELECT *, sum(excess) OVER (ORDER BY word_id) AS until, sum(excess) OVER (ORDER BY word_id) - excess AS start,
    lead(word_id) OVER (ORDER BY word_id) AS following
  FROM slots WHERE excess > 0),
owns AS (
  SELECT l.slot, l.word_id, l.total + l.excess AS own, h.word_id AS alias, l.total
  FROM light l JOIN heavy h ON h.start <= l.start AND l.start < h.until
  UNION ALL
  SELECT h.slot, h.word_id, h.total - coalesce(l.until - h.until, 0),
    CASE WHEN l.slot IS NULL THEN h.word_id ELSE h.following END, h.total
  FROM heavy h LEFT JOIN light l ON l.start < h.until AND h.until < l.until
  UNION ALL
  SELECT slot, word_id, total, word_id, total FROM slots WHERE excess = 0),
alias_table AS (
  SELECT slot, word_id, (own::HUGEINT * 4294967296::HUGEINT // total::HUGEINT)::BIGINT AS threshold, alias FROM owns)
"""

def _network(x: str) -> str:
    """All rounds of the network over the number `x` with halves of `half` bits."""
    keys = ", ".join(f"{k}::BIGINT" for k in Permutation(1, "epoch-1").keys())
    mixed = (
        f"list_transform([((x & ((1::BIGINT << half) - 1)) * {FACTORS[0]} + k) % 4294967296], lambda a: "
        f"list_transform([(xor(a, a >> 15)::HUGEINT * {FACTORS[1]} % 4294967296)::BIGINT], lambda b: "
        "xor(b, b >> 13) % (1::BIGINT << half))[1])[1]"
    )
    step = f"lambda x, k: ((x & ((1::BIGINT << half) - 1)) << half) | xor(x >> half, {mixed})"
    return f"list_reduce([{keys}], {step}, {x}::BIGINT)"


_PERMUTATION = f"""
walk AS (
  SELECT gid AS step, {_network("gid")} AS x, s.n, half
  FROM t, (SELECT count(*) AS n, greatest(1, (length(bin(count(*) - 1)) + 1) // 2)::INT AS half FROM t) s
  UNION ALL
  SELECT step, {_network('x')}, n, half FROM walk WHERE x >= n)
"""

_PPMI = f"""
seen AS (
  SELECT doc_id, place, word_id FROM (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place
    FROM (SELECT doc_id, {_words('text')} AS w FROM documents))
  JOIN dictionary USING (word) WHERE word_id > 3),
cooccurring AS (
  SELECT a.word_id, b.word_id AS context_id, count(*) AS n
  FROM seen a JOIN seen b ON a.doc_id = b.doc_id AND b.place - a.place IN (-2, -1, 1, 2)
  GROUP BY a.word_id, b.word_id),
marginals AS (SELECT word_id, sum(n) AS n_word FROM cooccurring GROUP BY word_id),
total AS (SELECT sum(n) AS total FROM cooccurring)
"""


def _joined(list_: str, sep: str = " ") -> str:
    return f"array_to_string({list_}, '{sep}')"


def _tokenized(table: str, keys: str, text: str) -> str:
    return (
        f"SELECT {keys}, len(w) AS n_words, {_joined('w')} AS words "
        f"FROM (SELECT {keys}, {_words(text)} AS w FROM {table})"
    )


# --- vectors and attention --------------------------------------------------


def _rounded(value: str) -> str:
    return f"floor(({value}) * 10000 + 0.5) / 10000"


def _spread(vector: str, size: int) -> str:
    return ", ".join(f"{_rounded(f'{vector}[{k + 1}]')} AS h{k}" for k in range(size))


_TEXT_FEATURES = f"""
features AS (
  SELECT text, list(coalesce(m, 0.0) ORDER BY k) AS x
  FROM (
    SELECT text, k, avg(v[k]) AS m
    FROM (SELECT text, unnest(ids) AS word_id FROM padded) p
    LEFT JOIN (SELECT vec_id AS word_id, embedding::DOUBLE[] AS v FROM embeddings) e USING (word_id),
         range(1, {FEATURE_SIZE} + 1) g(k)
    WHERE word_id <> 2
    GROUP BY text, k)
  GROUP BY text)
"""


def _weights(name: str, rels: str, size_in: int, size_out: int = HEAD_SIZE) -> str:
    """name(rel, w, a1, a2): w holds one list of input weights per output."""
    return f"""
{name} AS (
  SELECT rel,
    list_transform(range({size_out}), lambda o: list_transform(range({size_in}),
      lambda k: ((k * 7 + o * 13 + rel * 29) % 11 - 5) / 20.0::DOUBLE)) AS w,
    list_transform(range({size_out}), lambda t: ((t * 5 + rel * 3) % 7 - 3) / 4.0::DOUBLE) AS a1,
    list_transform(range({size_out}), lambda t: (((t + {size_out}) * 5 + rel * 3) % 7 - 3) / 4.0::DOUBLE) AS a2
  FROM {rels} r(rel))
"""


def _attend(name: str, hidden: str, pairs: str, elu: bool, size: int = HEAD_SIZE) -> str:
    """name(gid, id, rel, out) from hidden(gid, id, rel, h, s1, s2) and pairs(gid, rel, src, dst)."""
    sums = ", ".join(f"sum(p * h[{o + 1}]) / sum(p) AS o{o}" for o in range(size))
    means = ", ".join(f"avg(h[{o + 1}]) AS o{o}" for o in range(size))

    def outputs(of):
        def act(x):
            return f"CASE WHEN {x} > 0 THEN {x} ELSE exp({x}) - 1 END" if elu else x

        return "[" + ", ".join(act(f"{of}.o{o}") for o in range(size)) + "]"

    return f"""
{name}_scored AS (
  SELECT c.gid, c.rel, src, d.h, CASE WHEN s.s1 + d.s2 > 0 THEN s.s1 + d.s2 ELSE 0.1 * (s.s1 + d.s2) END AS e
  FROM {pairs} c
  JOIN {hidden} s ON s.gid = c.gid AND s.rel = c.rel AND s.id = src
  JOIN {hidden} d ON d.gid = c.gid AND d.rel = c.rel AND d.id = dst),
{name}_tops AS (SELECT rel, src, max(e) AS top FROM {name}_scored GROUP BY rel, src),
{name}_mixed AS (
  SELECT rel, src AS id, {sums}
  FROM (SELECT rel, src, h, exp(e - top) AS p FROM {name}_scored JOIN {name}_tops USING (rel, src))
  GROUP BY rel, src),
{name}_means AS (SELECT gid, rel, {means} FROM {hidden} GROUP BY gid, rel),
{name} AS (
  SELECT n.gid, n.id, n.rel, CASE WHEN m.id IS NULL THEN {outputs('a')} ELSE {outputs('m')} END AS out
  FROM {hidden} n LEFT JOIN {name}_mixed m ON m.rel = n.rel AND m.id = n.id
  JOIN {name}_means a ON a.gid = n.gid AND a.rel = n.rel)
"""


def _project(name: str, source: str, keys: str, weights: str) -> str:
    """name(keys, rel, h, s1, s2) from source(keys, x)."""
    return f"""
{name} AS (
  SELECT {keys}, rel, h, list_dot_product(h, a1) AS s1, list_dot_product(h, a2) AS s2
  FROM (SELECT {keys}, rel, a1, a2, list_transform(w, lambda c: list_dot_product(x, c)) AS h
        FROM {source}, {weights}))
"""


def _two_layers(prefix: str, projected: str, channels: str) -> str:
    """prefix(gid, id, h) from projected(gid, id, rel, h, s1, s2) of the nodes."""
    return ",".join(
        [
            _attend(f"{prefix}_one", projected, channels, elu=True),
            f"""
{prefix}_hidden AS (
  SELECT gid, id, flatten(list(out ORDER BY rel)) AS x FROM {prefix}_one GROUP BY gid, id),
{prefix}_union AS (SELECT DISTINCT gid, 6 AS rel, src, dst FROM {channels})""",
            _project(f"{prefix}_two_in", f"{prefix}_hidden", "gid, id", "last"),
            _attend(f"{prefix}_two", f"{prefix}_two_in", f"{prefix}_union", elu=False),
            f"{prefix} AS (SELECT gid, id, out AS h FROM {prefix}_two)",
        ]
    )


_LABELS = """
label_nodes AS (
  SELECT label::BIGINT AS gid, vec_id AS id, embedding::DOUBLE[] AS x,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
         count(*) OVER (PARTITION BY label) AS n
  FROM embeddings),
ring AS (
  SELECT a.gid, a.id AS src, b.id AS dst
  FROM label_nodes a JOIN label_nodes b ON a.gid = b.gid AND b.pos = (a.pos + 1) % a.n),
label_pairs AS (
  SELECT gid, 0 AS rel, src, dst FROM ring
  UNION SELECT gid, 0, dst, src FROM ring
  UNION SELECT gid, 0, id, id FROM label_nodes)
"""

_VIEWS = f"""
plain AS (SELECT gid, pos, x AS h FROM label_nodes),
masked AS (
  SELECT gid, pos, list_transform(x, lambda v: v * CASE WHEN {_replaced('id')} THEN 0.0 ELSE 0.9 END) AS h
  FROM label_nodes)
"""

_LOG_P = """
scores AS (
  SELECT a.gid, a.pos AS i, b.pos AS j, list_dot_product(a.h, b.h) AS s
  FROM plain a JOIN masked b ON a.gid = b.gid),
peaks AS (SELECT gid, i, max(s) AS top FROM scores GROUP BY gid, i),
sums AS (
  SELECT gid, i, any_value(top) + ln(sum(exp(s - top))) AS lse
  FROM scores JOIN peaks USING (gid, i) GROUP BY gid, i),
log_p AS (SELECT gid, i, j, s - lse AS p FROM scores JOIN sums USING (gid, i)),
losses AS (SELECT gid, count(*) AS n, avg(-p) AS loss FROM log_p WHERE i = j GROUP BY gid)
"""

_SIX = "(VALUES (0), (1), (2), (3), (4), (5))"
_NODE_HIDDEN = """
hidden_in AS (SELECT gid, id, rel, h, s1, s2 FROM nodes JOIN text_hidden USING (text))
"""
_FEATURE_PARTS = [
    _TABLES,
    _NODES,
    _TEXTS,
    _GRAPH_DICTIONARY,
    _ids("texts", "text"),
    _TEXT_FEATURES,
]
_ATTENTION_PARTS = [
    *_FEATURE_PARTS,
    _EDGES,
    _CHANNELS,
    _weights("first", _SIX, FEATURE_SIZE),
    _weights("last", "(VALUES (6))", 6 * HEAD_SIZE),
    _project("text_hidden", "features", "text", "first"),
    _NODE_HIDDEN,
]

_GRAPH_ROWS = """
  SELECT 'node' AS part, gid, id AS a, text AS b, type FROM kept
  UNION ALL
  SELECT 'edge', gid, src, dst, type FROM edges
  WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)
"""


def _subgraph(predicate: str) -> str:
    kept = f"kept AS (SELECT * FROM nodes WHERE {predicate})"
    return with_(_TABLES, _NODES, _EDGES, kept) + _GRAPH_ROWS


_POSITIONED = """
SELECT c.*, s.pos AS i, d.pos AS j FROM {pairs} c
JOIN nodes s ON s.gid = c.gid AND s.id = c.src JOIN nodes d ON d.gid = c.gid AND d.id = c.dst
"""

_RECORDS = (
    with_(_TABLES)
    + """SELECT oid::VARCHAR AS id, 'line,part,qty,flag' AS columns, coalesce(body, '') AS rows, caption AS questions
             FROM t LEFT JOIN (SELECT oid, string_agg(array_to_string(cells, ','), ';' ORDER BY r) AS body
                               FROM li GROUP BY oid) USING (oid)"""
)

ORACLES = {
    "table_size_filter": """
        SELECT l_suppkey::VARCHAR AS id, count(*) AS n_rows, count(*) * 5 AS n_cells
        FROM lineitem GROUP BY l_suppkey HAVING count(*) * 5 < 3000""",
    "assign_gid": with_(_TABLES) + "SELECT oid::VARCHAR AS id, gid FROM t",
    "graph_nodes": with_(_TABLES, _NODES) + "SELECT gid, row, col, pos, id, type, text FROM nodes",
    "graph_edges": with_(_TABLES, _NODES, _EDGES) + "SELECT gid, src, dst, type FROM edges",
    "graph_type_counts": with_(_TABLES, _NODES)
    + "SELECT type, count(*) AS n FROM nodes GROUP BY type",
    "table_count": with_(_TABLES) + "SELECT count(*) AS num FROM t",
    "parse_node_id": with_(_TABLES, _NODES) + "SELECT id, gid, row, col FROM nodes",
    "subgraph_single": _subgraph("id LIKE '7-%'"),
    "subgraph_batch": _subgraph(" OR ".join(f"id LIKE '{g}-%'" for g in range(100, 107))),
    "subgraph_by_id": _subgraph(" OR ".join(f"id LIKE '{g}-%'" for g in range(100, 107))),
    "induced_subgraph": _subgraph("type IN ('H', 'Cell', 'VE')"),
    "node_positions": with_(_TABLES, _NODES)
    + """SELECT gid, id, row_number() OVER (PARTITION BY gid ORDER BY row, col) - 1 AS pos
         FROM nodes WHERE type IN ('VE', 'Cell')""",
    "graph_batch_nodes": with_(_TABLES, _NODES)
    + """SELECT gid, 0::BIGINT AS block, string_agg(text, '|' ORDER BY pos) AS texts,
                string_agg(type, '|' ORDER BY pos) AS types FROM nodes GROUP BY gid""",
    "graph_batch_adjacency": with_(
        _TABLES, _NODES, _EDGES, f"p AS ({_POSITIONED.format(pairs='edges')})"
    )
    + """SELECT gid, count(*) AS n, string_agg(i || ':' || j, ',' ORDER BY i, j) AS pairs
         FROM p GROUP BY gid""",
    "tokenize_documents": _tokenized("documents", "doc_id", "text"),
    "tokenize_pages": _tokenized("pages", "page_id", "html"),
    "tokenize_conversations": _tokenized("conversations", "conv_id, turn", "text"),
    "sql_tokenize_documents": _tokenized("documents", "doc_id", "text"),
    "sql_word_counts": with_(_DOC_WORDS) + "SELECT word, cnt FROM counts",
    "sql_graph": _subgraph("true"),
    "sentence_split": f"""
        SELECT doc_id, sentence, len(w) AS n_words, {_joined('w')} AS words
        FROM (SELECT doc_id, sentence, {_words('part')} AS w
              FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS sentence
                    FROM (SELECT doc_id, string_split(replace(text, chr(10), '[SEP]'), '[SEP]') AS parts
                          FROM documents)))
        WHERE len(w) > 1""",
    "sentence_count": f"""
        SELECT count(*) AS num_sentences
        FROM (SELECT {_words('part')} AS w
              FROM (SELECT unnest(string_split(replace(text, chr(10), '[SEP]'), '[SEP]')) AS part FROM documents))
        WHERE len(w) > 1""",
    "skipgram_pairs": with_(_DOC_WORDS, _DICTIONARY, _KEPT)
    + f"""SELECT a.doc_id, a.pos, b.place - a.place AS step, a.word_id AS center, b.word_id AS context
          FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND a.place <> b.place
            AND abs(b.place - a.place) <= {_draw('pairs/width', 'a.doc_id, a.pos')} % 5 + 1""",
    "alias_table": with_(_DOC_WORDS, _DICTIONARY, _ALIAS)
    + "SELECT slot, word_id, threshold, alias FROM alias_table",
    "negative_samples": with_(
        _DOC_WORDS,
        _DICTIONARY,
        _KEPT,
        _ALIAS.replace("alias_table AS (", "alias_table AS MATERIALIZED ("),
        f"""drawn AS MATERIALIZED (
             SELECT doc_id, pos, word_id AS center, draw,
               {_draw('negatives/slot', 'doc_id, pos, draw', 15)} % n AS slot,
               {_draw('negatives/side', 'doc_id, pos, draw')} AS side
             FROM kept, range(0, 5) d(draw), (SELECT count(*) AS n FROM weights))""",
    )
    + """SELECT doc_id, pos, center, draw, CASE WHEN side < threshold THEN word_id ELSE alias END AS negative
         FROM drawn JOIN alias_table USING (slot)
         WHERE CASE WHEN side < threshold THEN word_id ELSE alias END <> center""",
    "cooccurrence_ppmi": with_(_DOC_WORDS, _DICTIONARY, _PPMI)
    + f"""SELECT c.word_id, c.context_id, n,
            {_rounded('ln(n::DOUBLE * total::DOUBLE / (a.n_word::DOUBLE * b.n_word::DOUBLE))')} AS value
          FROM cooccurring c JOIN marginals a ON a.word_id = c.word_id
          JOIN marginals b ON b.word_id = c.context_id, total
          WHERE n::HUGEINT * total::HUGEINT > a.n_word::HUGEINT * b.n_word::HUGEINT""",
    "vectors_round_trip": with_(_DOC_WORDS, _DICTIONARY)
    + f"""SELECT word_id, word, {_spread('e', 4)}
          FROM dictionary JOIN (SELECT vec_id AS word_id, embedding::DOUBLE[] AS e FROM embeddings) USING (word_id)""",
    "word_counts": with_(_DOC_WORDS) + "SELECT word, cnt FROM counts",
    "dictionary_size": with_(_DOC_WORDS) + "SELECT count(*) AS num_words FROM counts",
    "dictionary": with_(_DOC_WORDS, _DICTIONARY) + "SELECT word, cnt, word_id FROM dictionary",
    "frequent_dictionary": with_(_DOC_WORDS, _DICTIONARY) + "SELECT word, cnt, word_id FROM dictionary",
    "dictionary_round_trip": with_(_DOC_WORDS, _DICTIONARY)
    + "SELECT word, cnt, word_id FROM dictionary",
    "token_ids": with_(_DOC_WORDS, _DICTIONARY, _ids("documents", "doc_id"))
    + f"SELECT doc_id, len(ids) AS n_ids, {_joined('ids')} AS ids FROM ids",
    "padded_ids": with_(_DOC_WORDS, _DICTIONARY, _ids("documents", "doc_id"))
    + f"SELECT doc_id, {_joined('ids')} AS ids FROM padded",
    "pad_mask": with_(_DOC_WORDS, _DICTIONARY, _ids("documents", "doc_id"))
    + "SELECT doc_id, array_to_string(list_transform(ids, lambda x: (x <> 2)::INT), '') AS mask FROM padded",
    "relation_channels": with_(_TABLES, _NODES, _EDGES, _CHANNELS)
    + "SELECT gid, rel::BIGINT AS rel, src, dst FROM channels",
    "relation_multiplicity": with_(_TABLES, _NODES, _EDGES, _CHANNELS)
    + "SELECT gid, src, dst, count(*) AS n FROM channels GROUP BY gid, src, dst",
    "mask_nodes": with_(_TABLES, _NODES)
    + f"""SELECT id, {_replaced('id')} AS replaced,
            CASE WHEN {_replaced('id')} THEN -1 ELSE list_position([{_CODE_LIST}], type) - 1 END::BIGINT AS type_code,
            CASE WHEN {_selected('id')} THEN pos ELSE -1 END::BIGINT AS label
          FROM nodes""",
    "masked_channels": with_(_TABLES, _NODES, _EDGES, _CHANNELS, _MASKED)
    + "SELECT gid, rel::BIGINT AS rel, src, dst FROM masked_channels",
    "masked_channels_by_join": with_(_TABLES, _NODES, _EDGES, _CHANNELS, _MASKED)
    + "SELECT gid, rel::BIGINT AS rel, src, dst FROM masked_channels",
    "epoch_order": with_(_TABLES)
    + "SELECT gid, row_number() OVER (ORDER BY md5(gid || '-epoch-1'), gid) - 1 AS step FROM t",
    "epoch_permutation": with_(_TABLES, _PERMUTATION).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT x AS gid, step FROM walk WHERE x < n",
    "skipgram_scores": with_(
        "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, count(*) OVER () AS n FROM embeddings)"
    )
    + f"""SELECT a.vec_id AS center, b.vec_id AS context, {_rounded('list_dot_product(a.e, b.e)')} AS score
          FROM v a, range(1, 6) s(step) JOIN v b ON b.vec_id = (a.vec_id + step) % a.n""",
    "node_features": with_(*_FEATURE_PARTS)
    + f"SELECT id, {_spread('x', FEATURE_SIZE)} FROM nodes JOIN features USING (text)",
    "edge_softmax": with_(
        _LABELS,
        """scored AS (
             SELECT p.gid, src, dst, list_dot_product(a.x, b.x) AS e
             FROM label_pairs p JOIN label_nodes a ON a.id = src JOIN label_nodes b ON b.id = dst),
           tops AS (SELECT src, max(e) AS top FROM scored GROUP BY src)""",
    )
    + f"""SELECT gid, src, dst,
            {_rounded('exp(e - top) / sum(exp(e - top)) OVER (PARTITION BY src)')} AS weight
          FROM scored JOIN tops USING (src)""",
    "graph_attention": with_(
        _LABELS,
        _weights("first", "(VALUES (0))", FEATURE_SIZE),
        _project("label_hidden", "label_nodes", "gid, id", "first"),
        _attend("layer", "label_hidden", "label_pairs", elu=True),
    )
    + f"SELECT gid, id, {_spread('out', HEAD_SIZE)} FROM layer",
    "relational_attention": with_(
        *_ATTENTION_PARTS, _two_layers("embedded", "hidden_in", "channels")
    )
    + f"""SELECT e.gid, n.pos, {_spread('h', HEAD_SIZE)}
          FROM embedded e JOIN nodes n ON n.gid = e.gid AND n.id = e.id""",
    "contrastive_loss": with_(_LABELS, _VIEWS, _LOG_P)
    + f"SELECT gid, n, {_rounded('loss')} AS loss FROM losses",
    "contrastive_mean_loss": with_(_LABELS, _VIEWS, _LOG_P)
    + f"SELECT count(*) AS graphs, {_rounded('avg(loss)')} AS mean_loss FROM losses",
    "retrieval_top1": with_(
        _LABELS,
        _VIEWS,
        _LOG_P,
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY gid, j ORDER BY p DESC, i) AS place FROM log_p)",
    )
    + f"""SELECT gid, j::BIGINT AS pos, i::BIGINT AS best, {_rounded('p')} AS log_p
          FROM ranked WHERE place = 1""",
    "training_example_nodes": with_(
        _TABLES, _NODES, _TEXTS, _GRAPH_DICTIONARY, _ids("texts", "text")
    )
    + f"""SELECT gid, 0::BIGINT AS block, md5(string_agg({_joined('ids')}, '|' ORDER BY pos)) AS tokens,
            string_agg((list_position([{_CODE_LIST}], type) - 1)::VARCHAR, ' ' ORDER BY pos) AS type_codes
          FROM nodes JOIN padded USING (text) GROUP BY gid""",
    "training_example_adjacency": with_(
        _TABLES, _NODES, _EDGES, _CHANNELS, f"p AS ({_POSITIONED.format(pairs='channels')})"
    )
    + """SELECT gid, count(*) AS n, md5(string_agg(rel || ':' || i || ':' || j, ',' ORDER BY rel, i, j)) AS entries
         FROM p GROUP BY gid""",
    "pretraining_loss": with_(
        *_ATTENTION_PARTS,
        _MASKED,
        _two_layers("embedded", "hidden_in", "channels"),
        f"""mask_feature AS (SELECT embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id = 1)""",
        _project("mask_hidden", "mask_feature", "x", "first"),
        """masked_in AS (
             SELECT n.gid, n.id, n.rel, coalesce(m.h, n.h) AS h, coalesce(m.s1, n.s1) AS s1, coalesce(m.s2, n.s2) AS s2
             FROM hidden_in n LEFT JOIN hidden k ON k.id = n.id
             LEFT JOIN mask_hidden m ON k.id IS NOT NULL AND m.rel = n.rel)""",
        _two_layers("embedded_masked", "masked_in", "masked_channels"),
        """plain AS (SELECT e.gid, pos, h FROM embedded e JOIN nodes n ON n.gid = e.gid AND n.id = e.id)""",
        """masked AS (SELECT e.gid, pos, h FROM embedded_masked e JOIN nodes n ON n.gid = e.gid AND n.id = e.id)""",
        _LOG_P,
    )
    + f"SELECT gid, n, {_rounded('loss')} AS loss FROM losses",
    "parse_interactions": _RECORDS,
    "interactions_source": _RECORDS,
    "interactions_stream": _RECORDS,
    "record_files_to_graph": with_(_TABLES, _NODES)
    + """SELECT type, count(*) AS n, count(DISTINCT gid) AS graphs, max(gid) AS last_gid
         FROM nodes GROUP BY type""",
    "incremental_graph": _subgraph("true"),
    "incremental_ledger": with_(_TABLES)
    + """SELECT (oid > (SELECT avg(o_orderkey) FROM orders))::INT AS increment, min(gid) AS first_gid, count(*) AS tables
         FROM t GROUP BY 1
         UNION ALL SELECT -1, 0, count(*) FROM t""",
    "graph_round_trip": with_(_TABLES, _NODES, _EDGES)
    + """SELECT type, count(*) AS n FROM nodes GROUP BY type
         UNION ALL SELECT type, count(*) FROM edges GROUP BY type
         UNION ALL SELECT 'graphs', count(*) FROM t""",
    "corpus_round_trip": with_(_TABLES, _NODES)
    + "SELECT text, count(*) AS n FROM nodes GROUP BY text",
    "corpus_csv_words": with_(_TABLES, _NODES, _counts("nodes", "nullif(text, '')"))
    + "SELECT word, cnt FROM counts",
    "corpus_line_words": with_(_TABLES, _NODES, _counts("nodes", "nullif(text, '')"))
    + "SELECT word, cnt FROM counts",
}
