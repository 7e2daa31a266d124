"""DuckDB twins: SQL of whole queries, or of the columns of a query that SQL can express.

Each is a plain form, written from the contract and not from the operator.
"""

from __future__ import annotations

#: (t): the 256 entries of the CRC-32 table, from its polynomial.
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""


def _crc32(blob: str) -> str:
    """CRC-32 of a BLOB expression, given crc_table's t."""
    steps = f"list_prepend(4294967295, list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::BIGINT))"
    return f"xor(4294967295, list_reduce({steps}, lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])))"


#: Jump consistent hashing as a recursive walk; slots by salted order, as the operator numbers them.
JUMP_SHARDING = f"""
WITH RECURSIVE {_CRC_TABLE},
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc32("encode(coalesce(text, ''))")} AS text_crc32
  FROM documents, crc_table),
walk AS (
  SELECT doc_id, doc_id::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END AS state,
    -1::BIGINT AS shard, -1::BIGINT AS grown, 0::BIGINT AS next FROM documents
  UNION ALL
  SELECT doc_id, state, CASE WHEN next < 24 THEN next ELSE shard END, next,
    floor((next + 1) * (2147483648.0::DOUBLE / (state // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, (state * 2862933555777941757 + 1) % 18446744073709551616 AS state, shard, grown, next FROM walk WHERE next < 25)),
landed AS (
  SELECT doc_id, size, text_crc32, shard::INTEGER AS shard, grown::INTEGER AS grown_shard,
    {_crc32("encode(doc_id::VARCHAR || ':' || text_crc32::VARCHAR)")} % (SELECT greatest(1, floor(sqrt(count(*))))::BIGINT FROM documents) AS salt
  FROM walk JOIN sized USING (doc_id), crc_table WHERE next >= 25)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY salt, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM landed
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _placed(patterns: dict[str, str]) -> str:
    """CTEs ending in placed (doc_id, kind, ord, s, e, hit): all matches and where they are."""
    parts = [
        f"SELECT doc_id, '{kind}' AS kind, {i} AS ord, regexp_extract_all(x, '{p}') AS hits, string_split_regex(x, '{p}') AS gaps FROM texts"
        for i, (kind, p) in enumerate((k, v.replace("'", "''")) for k, v in patterns.items())
    ]
    return f"""texts AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
cut AS ({" UNION ALL ".join(parts)}),
steps AS (SELECT doc_id, kind, ord, unnest(range(len(gaps))) AS i, unnest(gaps) AS gap, unnest(hits) AS hit FROM cut),
ends AS (
  SELECT doc_id, kind, ord, hit, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS e FROM steps),
placed AS (SELECT doc_id, kind, ord, e - length(hit) AS s, e, hit FROM ends WHERE hit IS NOT NULL)"""


def _digests(kinds: tuple[str, ...], order: str) -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY {order}), '')) AS base_sha256
FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id"""


_PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: The base columns of personal data.
PERSONAL_BASE = f"""
WITH {_placed(_PERSONAL)},
digits AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM placed),
kept AS (
  SELECT doc_id, kind, ord, s, e FROM digits WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1),
      lambda i: CASE WHEN i % 2 = 1 THEN d[-i]::INTEGER WHEN d[-i]::INTEGER > 4 THEN 2 * d[-i]::INTEGER - 9 ELSE 2 * d[-i]::INTEGER END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15 ELSE true END)
{_digests(tuple(_PERSONAL), "ord, s")}
"""

_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}

#: The base columns of the secret scan.
SECRET_BASE = f"""
WITH {_placed(_SECRETS)},
kept AS (
  SELECT doc_id, kind, ord, s, e FROM placed WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(hit, '{_ASSIGN.replace("'", "''")}', 1)) >= 12
    WHEN 'access' THEN length(hit) >= 18 ELSE length(hit) >= 16 END)
{_digests(tuple(_SECRETS), "s, ord")}
"""


def _little_endian(n: str, size: int) -> str:
    return " || ".join(f"lpad(hex(({n} >> {8 * i}) & 255), 2, '0')" for i in range(size))


#: Sizes and hashes of payloads and of the WAV files that hold them: all columns but the features.
MEDIA_PAYLOADS = f"""
WITH {_CRC_TABLE},
raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, b, greatest(64, ((octet_length(b) + 63) // 64) * 64)::BIGINT AS n FROM raw),
padded AS (SELECT doc_id, n_bytes, n, hex(b) || repeat('00', (n - n_bytes)::BIGINT) AS h FROM sized),
headed AS (
  SELECT *, hex('RIFF') || {_little_endian("(n + 36)", 4)} || hex('WAVEfmt ') || {_little_endian("16::BIGINT", 4)} || {_little_endian("1::BIGINT", 2)}
    || {_little_endian("1::BIGINT", 2)} || {_little_endian("16000::BIGINT", 4)} || {_little_endian("16000::BIGINT", 4)} || {_little_endian("1::BIGINT", 2)}
    || {_little_endian("8::BIGINT", 2)} || hex('data') || {_little_endian("n", 4)} AS header FROM padded)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(h)) AS payload_sha256, {_crc32("unhex(right(h, 128))")} AS tail_crc32,
  (n + 44)::BIGINT AS media_bytes, sha256(unhex(header || h)) AS media_sha256
FROM headed, crc_table
"""
