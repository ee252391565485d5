"""DuckDB SQL for what the contracts fix in every detail: the base columns of four operators.

Places come from the lengths of the matches and of the gaps between them.
"""

from __future__ import annotations

from . import secret_scan
from .licenses import BASE_PHRASES

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in BASE_PHRASES)

LICENSES = f"""WITH w AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
spot AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w), p AS (SELECT * FROM (VALUES {_PHRASES}) AS v(p, label)),
hit AS (SELECT r, i - 1 AS place, label FROM spot JOIN p ON spot.w[i] = p.p[1] WHERE spot.w[i : i + len(p.p) - 1] = p.p),
sums AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN sums USING (r)"""

#: kind: pattern, and what a match x must hold.
_DIGITS = "regexp_replace(x.v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN (length({_DIGITS}) - k) % 2 = 0 THEN {_DIGITS}[k]::INTEGER ELSE {_DIGITS}[k]::INTEGER * 2 - CASE WHEN {_DIGITS}[k]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_PRIVATE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(x.v, '.'), lambda p: coalesce(try_cast(p AS UHUGEINT), 256) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
_SECRET = {
    "assign": (secret_scan.ASSIGN.pattern, f"length(regexp_extract(x.v, '{secret_scan.ASSIGN.pattern.replace(chr(39), chr(39) * 2)}', 1)) >= 8"),
    "access": (secret_scan.ACCESS.pattern, "length(x.v) >= 16"),
    "hex": ("[0-9a-f]+", "length(x.v) >= 32"),
}


def _spans(kinds: dict[str, tuple[str, str]]) -> str:
    steps = ["t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents)"]
    for k, (kind, (pattern, holds)) in enumerate(kinds.items()):
        quoted = "'" + pattern.replace("'", "''") + "'"
        steps.append(
            f"g{k} AS (SELECT r, regexp_extract_all(text, {quoted}) AS hits, list_transform(regexp_split_to_array(text, {quoted}), lambda x: length(x)) AS gaps FROM t WHERE regexp_matches(text, {quoted})), "
            f"u{k} AS (SELECT r, unnest(hits) AS v, unnest(gaps[1 : len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM g{k}), "
            f"x{k} AS (SELECT r, v, sum(gap + length(v)) OVER (PARTITION BY r ORDER BY i) AS close FROM u{k}), "
            f"s{k} AS (SELECT r, (close - length(v))::BIGINT AS spot, {k} AS ord, '{kind}' AS kind, close::BIGINT AS close FROM x{k} x WHERE {holds})"
        )
    every = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(len(kinds)))
    steps.append(f"a AS (SELECT r, string_agg(kind || ':' || spot || ':' || close, ',' ORDER BY spot, ord) AS spans, {', '.join(f'count(*) FILTER (WHERE ord = {k}) AS n_{kind}' for k, kind in enumerate(kinds))} FROM ({every}) GROUP BY r)")
    return f"WITH {', '.join(steps)} SELECT doc_id, {', '.join(f'coalesce(n_{kind}, 0) AS n_{kind}' for kind in kinds)}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN a USING (r)"


PRIVATE, SECRETS = _spans(_PRIVATE), _spans(_SECRET)

_BYTES = "encode(coalesce(text, ''))"
MEDIA = f"""WITH b AS (SELECT doc_id, {_BYTES} AS b, octet_length({_BYTES}) AS n FROM documents)
SELECT doc_id, n::BIGINT AS n_bytes, greatest(64, (n + 63) // 64 * 64)::BIGINT AS payload_bytes, sha256(b || unhex(repeat('00', (greatest(64, (n + 63) // 64 * 64) - n)::INTEGER))) AS payload_sha256 FROM b"""
