"""SQL of the longer oracles, for DuckDB."""

from .sharding import BITS, BLOCKS


def rendezvous_sql(n_shards: int = 24) -> str:
    """Equal weights, as op3_rendezvous has them; the CRC-32 is folded byte by byte through its table."""
    draw = f"(('0x' || substr(md5(k || ':' || s::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << BITS)!r}"
    best = "list_reduce(list_transform(range(0, {n}), lambda s: {{'score': -1.0 / ln(" + draw + "), 'shard': s}}), lambda a, b: CASE WHEN b.score > a.score THEN b ELSE a END).shard::INT"
    return f"""
WITH step AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(0, 8)),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS v FROM range(0, 256) r(i))),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, (n + 8)::BIGINT AS size, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))))::BIGINT AS text_crc32,
    {best.format(n=n_shards)} AS shard, {best.format(n=n_shards + 1)} AS grown_shard, (('0x' || substr(md5(k), 18, 13))::BIGINT % {BLOCKS})::INT AS block FROM d, step)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard FROM e
"""


#: Every 50-byte string of every text, as hexadecimal digits, with the least doc_id that has it.
SUFFIX_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
s AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
p AS (SELECT r, i FROM s JOIN f USING (g) WHERE first < doc_id),
c AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true)::INT AS new FROM p),
u AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM c),
v AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM u GROUP BY r, run),
w AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS starts, list_prepend(0::BIGINT, list(b ORDER BY a)) AS ends FROM v GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE
    array_to_string(list_transform(range(1, len(ends) + 1), lambda j: substr(h, 2 * ends[j] + 1, 2 * (coalesce(starts[j], n) - ends[j]))), '') END)) AS kept_sha256
FROM d LEFT JOIN w USING (r)
"""
