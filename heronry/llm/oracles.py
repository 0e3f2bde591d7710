"""The operators that SQL can express, as SQL over ``documents``."""

from __future__ import annotations

from heronry.llm import fill_in_middle, prefix_trie, repetition, suffix_dedup

_BLANK = r"\x20\x09-\x0D"
_DOCS = "docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)"


def repetition_rules() -> str:
    """Words with their n-grams of each length; a word is covered if one of the n windows over it occurs twice."""
    lengths = sorted({*repetition.MOST_COVERED, repetition.BASE_WINDOW})
    next_words = ", ".join(f"lead(word, {k}) OVER one AS w{k}" for k in range(1, max(lengths)))
    join = lambda n: " || ' ' || ".join(["word", *(f"w{k}" for k in range(1, n))])
    grams = ", ".join(f"{join(n)} AS g{n}" for n in lengths)
    twice = ", ".join(f"(g{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{n}) > 1) AS s{n}" for n in lengths)
    inside = ", ".join(f"bool_or(s{n}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)
    shares = ", ".join(f"CAST(coalesce(sum(length(word)) FILTER (c{n}), 0) AS DOUBLE) / CAST(sum(length(word)) AS DOUBLE) AS r{n}" for n in repetition.MOST_COVERED)
    worst = "coalesce(greatest(" + ", ".join(f"r{n}" for n in repetition.MOST_COVERED) + "), 0.0::DOUBLE)"
    fine = " AND ".join(f"coalesce(r{n}, 0) <= {limit}" for n, limit in repetition.MOST_COVERED.items())
    return f"""WITH {_DOCS},
  lists AS (SELECT rid, regexp_extract_all(t, '[^{_BLANK}]+') AS ws FROM docs),
  words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM lists),
  ahead AS (SELECT rid, i, word, {next_words} FROM words WINDOW one AS (PARTITION BY rid ORDER BY i)),
  grams AS (SELECT rid, i, word, {grams} FROM ahead),
  twice AS (SELECT rid, i, word, {twice} FROM grams),
  inside AS (SELECT rid, i, word, {inside} FROM twice),
  counted AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (c{repetition.BASE_WINDOW}) AS n_repeat_words, {shares} FROM inside GROUP BY rid),
  lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs),
  kinds AS (SELECT rid, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^{_BLANK}]') GROUP BY rid, line),
  doubled AS (SELECT rid, sum(n - 1) AS n_dup_lines, CAST(sum((n - 1) * length(line)) AS DOUBLE) / greatest(1, sum(n * length(line))) AS dup_line_share FROM kinds GROUP BY rid),
  joined AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[{repetition.SYMBOLS}]', '', 'g')) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_share, 0.0::DOUBLE) AS dup_line_share, {worst} AS dup_gram_share, {fine} AS fine
    FROM docs LEFT JOIN counted USING (rid) LEFT JOIN doubled USING (rid)),
  judged AS (SELECT *, (n_words < {repetition.BASE_LEAST_WORDS} OR 100 * n_repeat_words > {repetition.BASE_MOST_REPEATED} * n_words) AS base_failed FROM joined)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_share, dup_gram_share,
    (NOT base_failed AND fine AND dup_line_share <= {repetition.MOST_IN_LINES}) AS kept FROM judged"""


def suffix_array(length: int = suffix_dedup.LENGTH, passage: int = suffix_dedup.PASSAGE) -> str:
    """Every string of each length by its hash; the runs of those that start twice are joined to spans."""

    def spans(n: int) -> str:
        return f"""
  all{n} AS (SELECT rid, p, hash(b[p + 1 : p + {n}]) AS k FROM (SELECT rid, b, unnest(range(0, n - {n} + 1)) AS p FROM raw WHERE n >= {n})),
  twice{n} AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY k) AS c FROM all{n}) WHERE c > 1),
  steps{n} AS (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= {n} THEN 0 ELSE 1 END AS new FROM twice{n}),
  runs{n} AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run FROM steps{n}),
  spans{n} AS (SELECT rid, run, min(p) AS a, max(p) + {n} AS z FROM runs{n} GROUP BY rid, run),
  sums{n} AS (SELECT rid, sum(z - a) AS n_bytes, count(*) AS n_spans FROM spans{n} GROUP BY rid)"""

    return f"""WITH {_DOCS}, raw AS (SELECT rid, doc_id, encode(t) AS b, strlen(t) AS n FROM docs), {spans(length)}, {spans(passage)},
  gaps AS (SELECT rid, run, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY run), 0) AS a, a AS z FROM spans{length} UNION ALL SELECT rid, NULL, max(z), NULL FROM spans{length} GROUP BY rid),
  pieces AS (SELECT rid, string_agg(hex(b[gaps.a + 1 : coalesce(gaps.z, raw.n)]), '' ORDER BY run NULLS LAST) AS h FROM gaps JOIN raw USING (rid) GROUP BY rid)
  SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(s.n_bytes, 0) AS BIGINT) AS n_removed, coalesce(s.n_spans, 0) AS n_spans, sha256(coalesce(unhex(h), b)) AS kept_sha256,
    CAST(coalesce(q.n_bytes, 0) AS BIGINT) AS n_passage_bytes, coalesce(q.n_spans, 0) AS n_passages
  FROM raw LEFT JOIN sums{length} AS s USING (rid) LEFT JOIN sums{passage} AS q USING (rid) LEFT JOIN pieces USING (rid)"""


def crc32(text: str) -> str:
    """CRC-32 of a text's bytes: each byte is put in, then eight bits are shifted out."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda d: [CAST(ascii(d) AS BIGINT)] || list_transform(range(8), lambda z: -1::BIGINT)))"
    step = "lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {step}), 4294967295::BIGINT)"


def fill_in_middle_forms() -> str:
    """Units as a list, cut at the two ranks."""
    unit = f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+"
    draw = ", ".join(f"CAST('0x' || substring(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    p, s, m = fill_in_middle.PREFIX, fill_in_middle.SUFFIX, fill_in_middle.MIDDLE
    plain = f"t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {fill_in_middle.PLAIN_PERCENT}"
    return f"""WITH {_DOCS},
  drawn AS (SELECT *, {draw} FROM (SELECT *, sha256('{fill_in_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(t, '{unit}') AS u FROM docs)),
  formed AS (SELECT *, len(u) AS n, CASE WHEN {plain} THEN 'plain' WHEN h4 % 100 < {fill_in_middle.SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM drawn),
  parts AS (SELECT doc_id, t, n, form, CASE WHEN form <> 'plain' THEN array_to_string(u[1:a], '') END AS pre, CASE WHEN form <> 'plain' THEN array_to_string(u[a + 1:b], '') END AS mid, CASE WHEN form <> 'plain' THEN array_to_string(u[b + 1:], '') END AS suf FROM formed)
  SELECT doc_id, n, form, length(pre) AS prefix_chars, length(mid) AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""


def conversation_trie() -> str:
    """Every prefix of every rebuilt conversation; sums over subtrees by handing each node to all prefixes of its own."""
    f, h = prefix_trie.FAMILY, crc32("CAST(a.conv_id AS VARCHAR)")
    return f"""WITH turns AS (SELECT conv_id, turn, md5(length(r) || ':' || r || t) AS k, len(regexp_extract_all(t, '[^{_BLANK}]+')) AS w FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
  own AS (SELECT conv_id, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, k) AS p FROM turns GROUP BY conv_id),
  heads AS (SELECT a.conv_id, a.p, b.p AS head, CAST({h} % {prefix_trie.HEADS} AS BIGINT) AS h FROM own AS a LEFT JOIN own AS b ON b.conv_id = a.conv_id - a.conv_id % {f}),
  built AS (SELECT conv_id, list_concat(CASE WHEN head IS NULL THEN [] ELSE head[1:h] END, p[h + 1:]) AS p FROM heads),
  depths AS (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS depth FROM built),
  named AS (SELECT conv_id, depth, len(p) = depth AS ended, md5(array_to_string(list_transform(p[1:depth], lambda x: x.k), '')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(p[1:depth - 1], lambda x: x.k), '')) END AS above, CASE WHEN depth > 0 THEN p[depth].w ELSE 0 END AS w,
    list_transform(range(0, depth + 1), lambda d: md5(array_to_string(list_transform(p[1:d], lambda x: x.k), ''))) AS ups FROM depths),
  nodes AS (SELECT node, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, arg_min(ups, conv_id) AS ups, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM named GROUP BY node, depth),
  kids AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
  full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
  sums AS (SELECT up AS node, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens FROM (SELECT n_children, n_convs, w, unnest(ups) AS up FROM full_nodes) GROUP BY up)
  SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256 FROM full_nodes AS x JOIN sums ON sums.node = x.node LEFT JOIN nodes AS y ON y.node = x.above"""


ORACLE_SQL: dict[str, str] = {
    "op3_repetition_rules": repetition_rules(),
    "op7_suffix_array": suffix_array(),
    "op12_prefix_trie": conversation_trie(),
    "op13_fill_in_middle": fill_in_middle_forms(),
}
