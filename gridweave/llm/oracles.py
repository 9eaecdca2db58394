"""SQL with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from gridweave.llm import mixing, rules, secret_scan

WORD = r"'[^\x20\x09-\x0D]+'"

RULES = rf"""
    WITH words AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS words
        FROM documents
    ), windows AS (
        SELECT doc_id, i, array_to_string(words[i : i + {rules.WINDOW - 1}], ' ') AS win
        FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - {rules.WINDOW - 2}))) AS i FROM words)
    ), again AS (
        SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
    ), covered AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM again, range(0, {rules.WINDOW}) k(k) GROUP BY doc_id
    ), counts AS (
        SELECT doc_id, words, len(words)::BIGINT AS n_words,
               coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORD})) AS lines,
               coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM words LEFT JOIN covered USING (doc_id)
    ), judged AS (
        SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
               n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed
        FROM counts
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed
                OR 10 * n_symbols > 3 * n_words
                OR word_chars NOT BETWEEN 2 * n_words AND 25 * n_words
                OR 2 * n_dup_lines > len(lines)
                OR 2 * len(list_filter(words, lambda w: ends_with(w, '!!'))) > n_words
                OR 2 * len(list_filter(words, lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) > n_words
                OR (n_words >= 50 AND len(list_distinct(words)) ** 2 < n_words)) AS kept
    FROM judged
"""

WARC = """
    WITH payloads AS (
        SELECT page_id, coalesce(html, '') AS payload FROM pages
    ), digests AS (
        SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
               array_to_string(list_transform(string_split(sha1(payload), ''),
                   lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits,
               max(page_id) OVER (PARTITION BY payload) AS last
        FROM payloads
    )
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (list_sum(list_transform(range(0, 5), lambda b: substr(bits, (5 * i + b + 1)::INT, 1)::INT << (4 - b)::INT)) + 1)::INT, 1)),
               '') AS payload_digest,
           CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to
    FROM digests
"""


def _secrets() -> str:
    kinds = []
    for place, rule in enumerate(secret_scan.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        kinds.append(
            f"""
            SELECT doc_id, '{rule.kind}' AS kind, {place} AS place,
                   string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}) AS own,
                   regexp_extract_all(text, {pattern}, {rule.group}) AS held, {rule.least} AS least
            FROM texts"""
        )
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)
    line = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)"
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        scans AS ({" UNION ALL ".join(kinds)}),
        matches AS (
            SELECT *, unnest(range(1, len(own) + 1)) AS k FROM scans WHERE len(own) > 0
        ), spans AS (
            SELECT doc_id, kind, place,
                   list_sum(list_transform(gaps[1:k], lambda x: length(x)))::BIGINT
                   + coalesce(list_sum(list_transform(own[1 : k - 1], lambda x: length(x))), 0)::BIGINT AS start,
                   length(own[k]) AS size
            FROM matches WHERE length(held[k]) >= least
        ), placed AS (SELECT *, start + size AS stop FROM spans)
        SELECT t.doc_id, {counts},
               sha256(coalesce({line} FILTER (kind IN ({base})), '')) AS base_sha256,
               coalesce({line}, '') AS spans
        FROM texts t LEFT JOIN placed p USING (doc_id) GROUP BY t.doc_id
    """


VECTORS = """
    WITH RECURSIVE links AS (
        SELECT a.vec_id AS a, b.vec_id AS b
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98
    ), reach AS (
        SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    )
    SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
           least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
           vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS kept
    FROM embeddings
"""


def _mixing() -> str:
    """The strata follow each other, so their SQL is written out one by one."""
    head = r"""
        WITH sized AS (
            SELECT doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
            FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, (1 + place % 3)::DOUBLE AS w, (3 * source_size)::DOUBLE AS most FROM sources
        ), levels AS (
            SELECT ((SELECT sum(source_size) FROM weighed)
                    - coalesce(sum(3 * source_size) OVER earlier, 0))::DOUBLE
                   / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER earlier, 0)) AS level
            FROM weighed
            WINDOW earlier AS (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), targets AS (
            SELECT source, source_size, least(most, (SELECT max(level) FROM levels) * w) AS target FROM weighed
        ), classed AS (
            SELECT *, length(bin(size)) AS class, row_number() OVER (
                PARTITION BY source ORDER BY size DESC, md5(concat_ws('-', doc_id, 'mix')), doc_id) - 1 AS i
            FROM sized
        ), classes AS (
            SELECT source, class, sum(size)::BIGINT AS words, count(*) AS docs, min(i) AS first_i
            FROM classed GROUP BY ALL
        ), rests AS (
            SELECT c.*, source_size, target, (source_size - coalesce(sum(words) OVER (
                PARTITION BY c.source ORDER BY class DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest
            FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
        ), placed AS (
            SELECT *, (SELECT count(*) FROM range(1, STRATA) k(k) WHERE rest * (1 << k::INT) <= source_size) AS stratum
            FROM rests
        ), strata AS (
            SELECT source, stratum, min(first_i) AS first_i, sum(docs)::BIGINT AS docs, sum(words)::BIGINT AS words
            FROM placed GROUP BY ALL
        ), docs AS (
            SELECT d.doc_id, d.source, d.size, d.i - s.first_i AS j, p.stratum, p.source_size, p.target
            FROM classed d
            JOIN placed p ON d.source IS NOT DISTINCT FROM p.source AND d.class = p.class
            JOIN strata s ON d.source IS NOT DISTINCT FROM s.source AND p.stratum = s.stratum
        ), state0 AS (
            SELECT source, target AS left_target, source_size AS left_words,
                   ('0x' || substr(md5('mix-' || coalesce(source, '')), 1, 4))::BIGINT / 65536.0::DOUBLE AS u
            FROM targets
        )"""
    step = """, rate{k} AS (
            SELECT source, u, CASE WHEN left_words > 0
                THEN least(greatest(left_target / left_words, 0.0::DOUBLE), 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
            FROM state{k}
        ), taken{k} AS (
            SELECT doc_id, d.source, size, source_size, target,
                   (least(floor(u + (j + 1) * rate) - floor(u + j * rate), 3) * size)::BIGINT AS taken
            FROM docs d JOIN rate{k} r ON d.source IS NOT DISTINCT FROM r.source WHERE stratum = {k}
        ), state{next} AS (
            SELECT t.source, left_target - coalesce(taken, 0) AS left_target,
                   left_words - coalesce(words, 0) AS left_words,
                   coalesce(t.u + docs * rate - floor(t.u + docs * rate), t.u) AS u
            FROM state{k} t JOIN rate{k} r ON t.source IS NOT DISTINCT FROM r.source
            LEFT JOIN (SELECT source, sum(taken)::BIGINT AS taken FROM taken{k} GROUP BY source) n
                ON t.source IS NOT DISTINCT FROM n.source
            LEFT JOIN (SELECT * FROM strata WHERE stratum = {k}) s ON t.source IS NOT DISTINCT FROM s.source
        )"""
    steps = "".join(step.format(k=k, next=k + 1) for k in range(mixing.STRATA))
    every = " UNION ALL ".join(
        f"SELECT doc_id, size, source_size, target, taken FROM taken{k}" for k in range(mixing.STRATA)
    )
    return head.replace("STRATA", str(mixing.STRATA)) + steps + every


INFILL = """
    WITH hashed AS (
        SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
               list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('1:' || doc_id), i, 8))::BIGINT) AS h
        FROM documents
    ), cuts AS (
        SELECT doc_id, text, n,
               CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 90 THEN 'plain'
                    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
               least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b
        FROM hashed
    ), parts AS (
        SELECT *, text[:a] AS prefix, text[a + 1 : b] AS middle, text[b + 1 :] AS suffix FROM cuts
    )
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text
                  WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts
"""

TOPK = """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )
    SELECT q.vec_id AS query_id,
           (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.w, c.w) DESC, c.vec_id))::INT AS rank,
           c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
    QUALIFY rank <= 20
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _crc32(text: str) -> str:
    """The checksum bit by bit; the text is ASCII."""
    step = "lambda c, x: xor(c >> 8, list_reduce(range(0, 8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, x) & 255))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT), {step}, 4294967295), 4294967295)"


MERKLE = f"""
    WITH RECURSIVE leaves AS (
        SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS place,
               (dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1)::BIGINT AS tree,
               (count(*) OVER (PARTITION BY lang))::BIGINT AS n
        FROM (
            SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
                   CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0
                        THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS claimed
            FROM documents
        )
    ), nodes AS (
        SELECT tree, 0 AS level, place, n, leaf AS h FROM leaves
        UNION ALL
        SELECT tree, level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place))
        FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2
    ), subroots AS (
        SELECT tree, h AS subroot FROM nodes WHERE n = 1
    ), tops AS (
        SELECT 0 AS level, tree AS place, count(*) OVER () AS n, subroot AS h FROM subroots
        UNION ALL
        SELECT level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place))
        FROM tops WHERE n > 1 GROUP BY level, place // 2
    ), forest AS (
        SELECT tree, level, place, n, h FROM nodes
        UNION ALL
        SELECT -1, level, place, n, h FROM tops
    ), walk AS (
        SELECT tree AS own, place AS lo, tree, 0 AS level, place, n, claimed AS h, '' AS proof FROM leaves
        UNION ALL
        SELECT w.own, w.lo,
               CASE WHEN w.n > 1 THEN w.tree ELSE -1 END,
               CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
               CASE WHEN w.n > 1 THEN w.place // 2 ELSE w.own END,
               CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE (SELECT count(*) FROM subroots) END,
               CASE WHEN w.n = 1 THEN w.h WHEN s.h IS NULL THEN sha256(w.h)
                    WHEN s.place < w.place THEN sha256(s.h || w.h) ELSE sha256(w.h || s.h) END,
               w.proof || coalesce(s.h, '')
        FROM walk w LEFT JOIN forest s
          ON w.n > 1 AND s.tree = w.tree AND s.level = w.level AND s.place = xor(w.place, 1)
        WHERE w.n > 1 OR w.tree >= 0
    ), ends AS (
        SELECT own, lo, h AS folded_root, proof FROM walk WHERE tree = -1 AND n = 1
    )
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM leaves JOIN subroots USING (tree)
    JOIN ends ON own = leaves.tree AND lo = leaves.place
    CROSS JOIN (SELECT h AS root FROM tops WHERE n = 1)
"""

ORACLES = {
    "op1_rules": RULES,
    "op2_warc": WARC,
    "op5_secrets": _secrets(),
    "op6_mixing": _mixing(),
    "op7_vectors": VECTORS,
    "op11_infill": INFILL,
    "op12_topk": TOPK,
    "op13_merkle": MERKLE,
}
