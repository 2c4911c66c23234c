"""BLAKE2b of short ASCII tokens in DuckDB's SQL, for oracles of the hashed vectors.

One block of at most 128 bytes, no key, eight bytes of digest: after RFC 7693.
"""

from __future__ import annotations

# Fixed values of BLAKE2b: initial state and the order of message words in its rounds.
IV = (
    0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1,
    0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179,
)
SIGMA = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15),
    (14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3),
    (11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4),
    (7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8),
    (9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13),
    (2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9),
    (12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11),
    (13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10),
    (6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5),
    (10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0),
)
ROTATIONS = (32, 24, 16, 63)
_MIXED = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_TWO64 = "18446744073709551616::UHUGEINT"


def _plus(*terms: str) -> str:
    return f"(({' + '.join(f'{t}::UHUGEINT' for t in terms)}) % {_TWO64})::UBIGINT"


def _turned(x: str, by: int) -> str:
    return f"(({x} // {1 << by}::UBIGINT) | ((({x})::UHUGEINT * {1 << (64 - by)}::UHUGEINT) % {_TWO64})::UBIGINT)"


def tokens_sql(name: str, source: str) -> str:
    """CTEs that end in `name`(tok, bucket, sign) for the distinct tokens that `source` (tok) yields: bucket of 384, sign by bit 1."""
    words = [" + ".join(f"coalesce(unicode(nullif(substr(tok, {8 * w + i + 1}, 1), '')), 0)::UHUGEINT * {1 << (8 * i)}::UHUGEINT" for i in range(8)) for w in range(16)]
    state = [*IV, *IV]
    state[0] ^= 0x01010000 ^ 8
    start = ", ".join(f"{x}::UBIGINT AS v{i}" for i, x in enumerate(state) if i not in (12, 14))
    start += f", xor({state[12]}::UBIGINT, length(tok)::UBIGINT) AS v12, {state[14] ^ (1 << 64) - 1}::UBIGINT AS v14"
    out = [f"{name}_0 AS MATERIALIZED (SELECT tok, {', '.join(f'({w})::UBIGINT AS m{i}' for i, w in enumerate(words))}, {start} FROM (SELECT DISTINCT tok FROM ({source})))"]
    at = 0

    def step(changed: dict[str, str]) -> None:
        nonlocal at
        shown = ", ".join(f"{x} AS {c}" for c, x in changed.items())
        out.append(f"{name}_{at + 1} AS MATERIALIZED (SELECT * REPLACE ({shown}) FROM {name}_{at})")
        at += 1

    for r in range(12):
        order = SIGMA[r % 10]
        for half in (0, 4):
            quads = list(enumerate(_MIXED[half : half + 4], half))
            for part in (0, 1):
                step({f"v{a}": _plus(f"v{a}", f"v{b}", f"m{order[2 * k + part]}") for k, (a, b, c, d) in quads})
                step({f"v{d}": _turned(f"xor(v{d}, v{a})", ROTATIONS[2 * part]) for k, (a, b, c, d) in quads})
                step({f"v{c}": _plus(f"v{c}", f"v{d}") for k, (a, b, c, d) in quads})
                step({f"v{b}": _turned(f"xor(v{b}, v{c})", ROTATIONS[2 * part + 1]) for k, (a, b, c, d) in quads})
    least = f"xor(xor({state[0]}::UBIGINT, v0), v8)"
    whole = " + ".join(f"(h // {1 << (8 * i)}::UBIGINT % 256)::UHUGEINT * {1 << (8 * (7 - i))}::UHUGEINT" for i in range(8))
    out.append(f"{name} AS MATERIALIZED (SELECT tok, (b % 384)::BIGINT AS bucket, CASE WHEN b // 2 % 2 = 1 THEN 1 ELSE -1 END AS sign FROM (SELECT tok, ({whole})::UBIGINT AS b FROM (SELECT tok, {least} AS h FROM {name}_{at})))")
    return ",\n".join(out)
