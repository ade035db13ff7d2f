"""Independent SQL for the named queries, for a plain SQL engine over the same tables.

Everything is written in long form (one row per matrix entry), unlike the Spark side.
"""

from __future__ import annotations

SUPPLY = """
  SELECT CAST(l_suppkey AS BIGINT) AS i0, CAST(l_partkey AS BIGINT) AS i1,
         CAST(year(l_shipdate) * 12 + month(l_shipdate) - 23941 AS BIGINT) AS i2,
         l_quantity AS val
  FROM lineitem"""
SUPPLY_KEPT = SUPPLY + " WHERE l_returnflag <> 'R'"
SUPPLY2 = "SELECT i0, i1, val FROM (" + SUPPLY + ")"
SUPPLY5 = """
  SELECT CAST(l_suppkey AS BIGINT) AS i0, CAST(l_partkey AS BIGINT) AS i1,
         CAST(year(l_shipdate) * 12 + month(l_shipdate) - 23941 AS BIGINT) AS i2,
         CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS i3,
         CAST(l_linenumber - 1 AS BIGINT) AS i4, l_quantity AS val
  FROM lineitem"""
MARKET = """
  SELECT CAST(c_nationkey AS BIGINT) AS i0, CAST(left(o_orderpriority, 1) AS BIGINT) - 1 AS i1,
         CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS i2,
         CAST(l_linenumber - 1 AS BIGINT) AS i3, l_quantity AS val
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
ACTIVITY = """
  SELECT CAST(user_id AS BIGINT) AS i0,
         CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
              WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS i1,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS i2,
         CAST(1 AS DOUBLE) AS val
  FROM events"""


def _idx(modes: int) -> str:
    return ", ".join(f"i{n}" for n in range(modes))


def _summed(raw: str, modes: int) -> str:
    return f"SELECT {_idx(modes)}, sum(val) AS val FROM ({raw}) GROUP BY {_idx(modes)}"


def _factor(w: int, rank: int, source: str = "t") -> str:
    """Rows ``0 .. max`` of factor ``w`` as ``(i, r, v)``."""
    return f"""f{w} AS (
  SELECT CAST(i AS BIGINT) AS i, r,
         CAST(((i * {7 + 2 * w} + (r + 1) * {13 + w}) % 11) - 5 AS DOUBLE) AS v
  FROM (SELECT unnest(range((SELECT max(i{w}) + 1 FROM {source}))) AS i),
       (SELECT unnest(range({rank})) AS r))"""


def _factors(modes: int, rank: int, source: str = "t") -> str:
    return ", ".join(_factor(w, rank, source) for w in range(modes))


def _long(n: int, modes: int, source: str = "t") -> str:
    """Mode-``n`` MTTKRP as ``(i, r, y)``."""
    others = [w for w in range(modes) if w != n]
    first = others[0]
    joins = f"JOIN f{first} ON f{first}.i = {source}.i{first}" + "".join(
        f" JOIN f{w} ON f{w}.i = {source}.i{w} AND f{w}.r = f{first}.r" for w in others[1:]
    )
    product = " * ".join(["val", *[f"f{w}.v" for w in others]])
    return (
        f"SELECT CAST(i{n} AS BIGINT) AS i, f{first}.r AS r, sum({product}) AS y "
        f"FROM {source} {joins} GROUP BY i{n}, f{first}.r"
    )


def _wide(long_sql: str, rank: int, prefix: str = "y", lead: str = "i") -> str:
    cells = ", ".join(
        f"sum(CASE WHEN r = {r} THEN y END) AS {prefix}{r}" for r in range(rank)
    )
    return f"SELECT {lead}, {cells} FROM ({long_sql}) GROUP BY {lead}"


def _mttkrp(raw: str, modes: int, n: int, rank: int) -> str:
    return f"WITH t AS ({raw}), {_factors(modes, rank)} {_wide(_long(n, modes), rank)}"


def _mttkrp_all(raw: str, modes: int, rank: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT CAST({n} AS INTEGER) AS mode, * FROM ({_long(n, modes)})" for n in range(modes)
    )
    return (
        f"WITH t AS ({raw}), {_factors(modes, rank)} {_wide(parts, rank, lead='mode, i')}"
    )


def _outputs(rank: int = 4) -> str:
    """CTEs y0, y1, y2: the supply tensor's MTTKRP outputs in long form."""
    ys = ", ".join(f"y{n} AS ({_long(n, 3)})" for n in range(3))
    return f"WITH t AS ({SUPPLY}), {_factors(3, rank)}, {ys}"


def _gram(source: str, value: str = "y") -> str:
    return (
        f"SELECT CAST(a.r AS INTEGER) AS r, CAST(b.r AS INTEGER) AS s, "
        f"sum(a.{value} * b.{value}) AS g "
        f"FROM {source} a JOIN {source} b ON a.i = b.i GROUP BY a.r, b.r"
    )


def _pairs(modes: int = 3, source: str = "t") -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({n} AS INTEGER) AS mode, CAST(i{n} AS BIGINT) AS i FROM {source}"
        for n in range(modes)
    )


def _sizes(modes: int = 3) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({n} AS INTEGER) AS mode, CAST(max(i{n}) + 1 AS BIGINT) AS size, "
        f"count(*) AS nnz FROM t"
        for n in range(modes)
    )


def _shards() -> str:
    """CTEs up to ``s(mode, shard, nnz)``: at most 64 ranges of rows for each mode."""
    return f"""WITH t AS ({SUPPLY}), sizes AS ({_sizes()}),
  rows_per AS (
    SELECT mode, CAST(pow(2, greatest(0, ceil(log2(size)) - 6)) AS BIGINT) AS m FROM sizes),
  s AS (
    SELECT p.mode, p.i // m AS shard, count(*) AS nnz
    FROM ({_pairs()}) p JOIN rows_per USING (mode) GROUP BY p.mode, p.i // m)"""


def _morton_64() -> str:
    """Statistics of keys with bits dealt to modes of 2^22, 2^21 and 2^21 rows."""
    sizes = (1 << 22, 1 << 21, 1 << 21)
    top = ", ".join(f"{s - 1} - i{n} AS i{n}" for n, s in enumerate(sizes))
    bits = [(n, b, 3 * b + n) for b in range(21) for n in range(3)] + [(0, 21, 63)]
    key = " + ".join(f"CAST((i{n} >> {b}) & 1 AS HUGEINT) * {1 << at}" for n, b, at in bits)
    sums = ", ".join(f"CAST(sum(i{n}) AS BIGINT) AS sum_i{n}" for n in range(3))
    return f"""WITH t AS ({_summed(SUPPLY, 3)}), u AS (SELECT {top}, val FROM t),
  k AS (SELECT *, CAST({key} - {1 << 63} AS BIGINT) AS key FROM u)
  SELECT count(*) AS nnz, {sums}, sum(i0 * val) AS weighted, min(key) AS low, max(key) AS high
  FROM k"""


def _morton() -> str:
    """CTEs up to ``k(i0, i1, i2, val, key)``; bit positions are computed in SQL."""
    return f"""WITH t AS ({_summed(SUPPLY, 3)}), sizes AS ({_sizes()}),
  width AS (SELECT mode, greatest(1, CAST(ceil(log2(size)) AS INTEGER)) AS bits FROM sizes),
  plan AS (
    SELECT w.mode, b.bit,
           (SELECT sum(least(o.bits, b.bit)) FROM width o)
         + (SELECT count(*) FROM width o WHERE o.mode < w.mode AND o.bits > b.bit) AS pos
    FROM width w, (SELECT unnest(range(32)) AS bit) b WHERE b.bit < w.bits),
  key_parts AS ({' UNION ALL '.join(
      f'SELECT i0, i1, i2, val, (((CAST(i{n} AS BIGINT) >> CAST(bit AS BIGINT)) & 1) << CAST(pos AS BIGINT)) AS part '
      f'FROM t JOIN plan ON mode = {n}' for n in range(3))}),
  k AS (SELECT i0, i1, i2, val, CAST(sum(part) AS BIGINT) AS key
        FROM key_parts GROUP BY i0, i1, i2, val)"""


def _als_rank2() -> str:
    v = "(SELECT sum(a.v * b.v) FROM f{w} a JOIN f{w} b ON a.i = b.i WHERE a.r = {r} AND b.r = {s})"

    def cell(r: int, s: int) -> str:
        return " * ".join(v.format(w=w, r=r, s=s) for w in (1, 2))

    return f"""WITH t AS ({SUPPLY}), {_factors(3, 2)},
  g AS (SELECT {cell(0, 0)} AS a, {cell(0, 1)} AS b, {cell(1, 1)} AS d),
  y AS ({_wide(_long(0, 3), 2)})
  SELECT i, round((y0 * d - y1 * b) / (a * d - b * b), 6) + 0.0 AS f0,
         round((y1 * a - y0 * b) / (a * d - b * b), 6) + 0.0 AS f1
  FROM y, g"""


def _solved(rank: int) -> str:
    """``y V^-1`` for the symmetric V with entries ``vrs``, by its adjugate."""
    v = lambda r, s: f"v{min(r, s)}{max(r, s)}"
    if rank == 1:
        return "y0 / v00 AS x0"
    if rank == 2:
        det = "(v00 * v11 - v01 * v01)"
        return f"(y0 * v11 - y1 * v01) / {det} AS x0, (y1 * v00 - y0 * v01) / {det} AS x1"

    def adjugate(r: int, s: int) -> str:
        a, b = [k for k in range(3) if k != r], [k for k in range(3) if k != s]
        minor = f"({v(a[0], b[0])} * {v(a[1], b[1])} - {v(a[0], b[1])} * {v(a[1], b[0])})"
        return minor if (r + s) % 2 == 0 else f"(0 - {minor})"

    det = "(" + " + ".join(f"v0{s} * {adjugate(0, s)}" for s in range(3)) + ")"
    return ", ".join(
        "(" + " + ".join(f"y{s} * {adjugate(r, s)}" for s in range(3)) + f") / {det} AS x{r}"
        for r in range(3)
    )


def _sweeps(sweeps: int, rank: int, jacobi: bool = False, tag: str = "") -> list[str]:
    """Sweeps on the market tensor, up to rank 3, as a chain of CTEs.

    ``c{n}_{k}(i, v0 ..)`` are the factors after sweep ``k`` and ``l{n}_{k}`` their norms.  A
    Gauss-Seidel sweep uses the newest factors, a Jacobi sweep those of the sweep before.
    Without ``jacobi`` and ``tag`` names are as given; ``tag`` is put before them.
    """
    ranks = range(rank)
    ctes = [] if tag else [f"t AS MATERIALIZED ({_summed(MARKET, 4)})"]
    for n in range(4):
        start = ", ".join(
            f"CAST({'1' if rank == 1 else f'((i * {7 + 2 * n} + {(r + 1) * (13 + n)}) % 11) - 5'} "
            f"AS DOUBLE) AS v{r}"
            for r in ranks
        )
        ctes.append(
            f"{tag}c{n}_0 AS MATERIALIZED (SELECT i, {start} FROM (SELECT DISTINCT i{n} AS i FROM t))"
        )
    for k in range(1, sweeps + 1):
        for n in range(4):
            others = [(w, k if w < n and not jacobi else k - 1) for w in range(4) if w != n]
            joins = " ".join(f"JOIN {tag}c{w}_{p} ON {tag}c{w}_{p}.i = t.i{w}" for w, p in others)
            sums = ", ".join(
                f"sum({' * '.join(['val', *[f'{tag}c{w}_{p}.v{r}' for w, p in others]])}) AS y{r}"
                for r in ranks
            )
            ctes.append(
                f"{tag}y{n}_{k} AS MATERIALIZED (SELECT i{n} AS i, {sums} FROM t {joins} GROUP BY i{n})"
            )
            cells = ", ".join(
                " * ".join(f"(SELECT sum(v{r} * v{s}) FROM {tag}c{w}_{p})" for w, p in others)
                + f" AS v{r}{s}"
                for r in ranks
                for s in range(r, rank)
            )
            ctes.append(f"{tag}g{n}_{k} AS MATERIALIZED (SELECT {cells})")
            ctes.append(
                f"{tag}x{n}_{k} AS MATERIALIZED "
                f"(SELECT i, {_solved(rank)} FROM {tag}y{n}_{k}, {tag}g{n}_{k})"
            )
            norms = ", ".join(f"sqrt(sum(x{r} * x{r})) AS lam{r}" for r in ranks)
            ctes.append(f"{tag}l{n}_{k} AS MATERIALIZED (SELECT {norms} FROM {tag}x{n}_{k})")
            scaled = ", ".join(f"x{r} / lam{r} AS v{r}" for r in ranks)
            ctes.append(
                f"{tag}c{n}_{k} AS MATERIALIZED (SELECT i, {scaled} FROM {tag}x{n}_{k}, {tag}l{n}_{k})"
            )
    return ctes


def _sweep_fits(sweeps: int, rank: int, jacobi: bool = False) -> str:
    """The fit after each sweep; the model is evaluated on every cell, as the tensor is small."""
    parts = []
    for k in range(1, sweeps + 1):
        model = " + ".join(
            " * ".join([f"lam{r}", *[f"c{w}_{k}.v{r}" for w in range(4)]]) for r in range(rank)
        )
        cells = f"c0_{k}, c1_{k}, c2_{k}, c3_{k}, l3_{k}"
        on = " AND ".join(f"t.i{w} = c{w}_{k}.i" for w in range(4))
        parts.append(
            f"SELECT CAST({k - 1} AS INTEGER) AS iter, "
            f"round(1 - sqrt(sum((coalesce(val, 0) - m) * (coalesce(val, 0) - m))) "
            f"/ sqrt(sum(coalesce(val, 0) * coalesce(val, 0))), 6) AS fit "
            f"FROM (SELECT val, {model} AS m FROM {cells.replace(', ', ' CROSS JOIN ')} "
            f"LEFT JOIN t ON {on})"
        )
    return f"WITH {', '.join(_sweeps(sweeps, rank, jacobi))} {' UNION ALL '.join(parts)}"


def _similarity(sweeps: int) -> str:
    """Mean absolute cosine of the factors of both kinds of rank-1 sweeps."""
    ctes = [*_sweeps(sweeps, 1), *_sweeps(sweeps, 1, True, "j")]
    cosines = " UNION ALL ".join(
        f"SELECT abs(sum(a.v0 * b.v0)) / sqrt(sum(a.v0 * a.v0) * sum(b.v0 * b.v0)) AS c "
        f"FROM c{n}_{sweeps} a JOIN jc{n}_{sweeps} b ON a.i = b.i"
        for n in range(4)
    )
    return f"WITH {', '.join(ctes)} SELECT round(avg(c), 6) AS similarity FROM ({cosines})"


def _sweep_factors(sweeps: int, rank: int) -> str:
    cells = ", ".join(f"round(v{r}, 6) + 0.0 AS f{r}" for r in range(rank))
    parts = [
        f"SELECT CAST({n} AS INTEGER) AS mode, CAST(i AS BIGINT) AS i, {cells} FROM c{n}_{sweeps}"
        for n in range(4)
    ]
    return f"WITH {', '.join(_sweeps(sweeps, rank))} {' UNION ALL '.join(parts)}"


def _rank1_jacobi() -> str:
    """One Jacobi iteration from all-ones factors; the fit sums over the nonzeros."""
    ctes = [f"t AS ({_summed(MARKET, 4)})"]
    for n in range(4):
        scale = " * ".join(
            f"(SELECT max(i{w}) + 1 FROM t)" for w in range(4) if w != n
        )
        ctes.append(f"x{n} AS (SELECT i{n} AS i, sum(val) / ({scale}) AS x FROM t GROUP BY i{n})")
        ctes.append(f"l{n} AS (SELECT sqrt(sum(x * x)) AS lam FROM x{n})")
        ctes.append(f"c{n} AS (SELECT i, x / lam AS v FROM x{n}, l{n})")
    joins = " ".join(f"JOIN c{w} ON c{w}.i = t.i{w}" for w in range(4))
    return (
        f"WITH {', '.join(ctes)} SELECT CAST(0 AS INTEGER) AS iter, "
        "round(1 - sqrt(greatest(0, sum(val * val) - 2 * sum(val * lam * c0.v * c1.v * c2.v * c3.v)"
        f" + max(lam * lam))) / sqrt(sum(val * val)), 6) AS fit FROM t {joins}, l3"
    )


def _model_at() -> str:
    """Model with weights 1 and 2 at every nonzero of the supply tensor."""
    return f"""WITH t AS ({_summed(SUPPLY, 3)}), {_factors(3, 2)}
  SELECT t.i0, t.i1, t.i2, val, sum((f0.r + 1) * f0.v * f1.v * f2.v) AS model
  FROM t JOIN f0 ON f0.i = i0 JOIN f1 ON f1.i = i1 AND f1.r = f0.r
         JOIN f2 ON f2.i = i2 AND f2.r = f0.r
  GROUP BY t.i0, t.i1, t.i2, val"""


def _residual() -> str:
    """Brute force over every cell of the (small, dense) market tensor."""
    return f"""WITH t AS ({_summed(MARKET, 4)}), {_factors(4, 2)},
  cell AS (
    SELECT f0.i AS i0, f1.i AS i1, f2.i AS i2, f3.i AS i3,
           sum((f0.r + 1) * f0.v * f1.v * f2.v * f3.v) AS m
    FROM f0 JOIN f1 ON f1.r = f0.r JOIN f2 ON f2.r = f0.r JOIN f3 ON f3.r = f0.r
    GROUP BY f0.i, f1.i, f2.i, f3.i)
  SELECT sum(coalesce(val, 0) * coalesce(val, 0)) AS norm_sq, sum(coalesce(val, 0) * m) AS inner,
         sum(m * m) AS model_sq, sum((coalesce(val, 0) - m) * (coalesce(val, 0) - m)) AS resid_sq
  FROM cell LEFT JOIN t USING (i0, i1, i2, i3)""".replace(" AS inner", ' AS "inner"')


def _compare() -> str:
    kept = _long(0, 3, "kept")
    return f"""WITH t AS ({SUPPLY}), kept AS ({SUPPLY_KEPT}), {_factors(3, 4)},
  want AS ({_long(0, 3)}), got AS ({kept}),
  d AS (SELECT coalesce(got.y, 0) AS g, coalesce(want.y, 0) AS w
        FROM got FULL JOIN want ON got.i = want.i AND got.r = want.r)
  SELECT round(sqrt(sum((g - w) * (g - w))) / sqrt(sum(w * w)), 6) AS frob_rel,
         round(max(abs(g - w)), 6) AS max_abs,
         round(max(CASE WHEN w <> 0 THEN abs(g - w) / abs(w) ELSE abs(g - w) END), 6) AS max_rel
  FROM d"""


_T3 = f"SELECT i0, i1, i2, val FROM ({_summed(SUPPLY, 3)})"

ORACLES: dict[str, str] = {
    "tensor_build": _T3,
    "events_tensor": _summed(ACTIVITY, 3),
    "market_tensor": _summed(MARKET, 4),
    "coalesce_duplicates": _summed(SUPPLY2, 2),
    "mode_sizes": f"WITH t AS ({_summed(SUPPLY, 3)}) SELECT mode, size, nnz FROM ({_sizes()})",
    "tensor_norm_sq": f"SELECT sum(val * val) AS norm_sq FROM ({_summed(SUPPLY, 3)})",
    "touched_rows": f"""WITH t AS ({SUPPLY})
      SELECT mode, size, touched, size - touched AS untouched
      FROM (SELECT mode, count(DISTINCT i) AS touched, max(i) + 1 AS size
            FROM ({_pairs()}) GROUP BY mode)""",
    "row_counts": f"""WITH t AS ({_summed(SUPPLY, 3)})
      SELECT mode, i, count(*) AS nnz FROM ({_pairs()}) GROUP BY mode, i""",
    "fiber_stats": f"""WITH t AS ({_summed(SUPPLY, 3)})
      SELECT mode, size, nnz, CAST(nnz AS DOUBLE) / size AS avg_fiber_len
      FROM ({_sizes()})""",
    "shard_counts": f"{_shards()} SELECT mode, shard, nnz FROM s",
    "shard_offsets": f"""{_shards()}
      SELECT mode, shard, CAST(e - nnz AS BIGINT) AS shard_begin, CAST(e AS BIGINT) AS shard_end
      FROM (SELECT *, sum(nnz) OVER (PARTITION BY mode ORDER BY shard) AS e FROM s)""",
    "csr_rowptr": f"""
      SELECT i, CAST(e - nnz AS BIGINT) AS row_begin, CAST(e AS BIGINT) AS row_end
      FROM (SELECT i, nnz, sum(nnz) OVER (ORDER BY i) AS e
            FROM (SELECT CAST(i1 AS BIGINT) AS i, count(*) AS nnz FROM ({SUPPLY}) GROUP BY i1))""",
    "mttkrp_mode0": _mttkrp(SUPPLY, 3, 0, 4),
    "mttkrp_mode1": _mttkrp(SUPPLY, 3, 1, 4),
    "mttkrp_mode2": _mttkrp(SUPPLY, 3, 2, 4),
    "mttkrp_long": f"""WITH t AS ({SUPPLY}), {_factors(3, 4)}
      SELECT i, CAST(r AS INTEGER) AS r, y FROM ({_long(0, 3)})""",
    "mttkrp_arrow": _mttkrp(SUPPLY, 3, 1, 16),
    "mttkrp_all_modes": _mttkrp_all(SUPPLY, 3, 4),
    "mttkrp_shuffle": _mttkrp(SUPPLY, 3, 0, 4),
    "mttkrp_blocked": _mttkrp(SUPPLY, 3, 2, 4),
    "mttkrp_blocked_mixed": _mttkrp_all(SUPPLY, 3, 4),
    "mttkrp_blocked_wide_key": _mttkrp(SUPPLY, 3, 0, 4),
    "mttkrp_all_modes_blocked": _mttkrp_all(SUPPLY, 3, 4),
    "mttkrp_mode_sorted": _mttkrp(SUPPLY, 3, 1, 4),
    "mttkrp_2mode": _mttkrp(SUPPLY2, 2, 0, 4),
    "mttkrp_bucketed": _mttkrp(SUPPLY, 3, 1, 4),
    "mttkrp_bucketed_sweep": _mttkrp_all(SUPPLY, 3, 16),
    "mttkrp_fiber_tree": _mttkrp(MARKET, 4, 0, 4),
    "mttkrp_compact": _mttkrp(SUPPLY, 3, 0, 4),
    "mttkrp_compact_all": _mttkrp_all(SUPPLY, 3, 4),
    "mode_marginals": f"WITH t AS ({SUPPLY}) "
    + " UNION ALL ".join(
        f"SELECT CAST({n} AS INTEGER) AS mode, i{n} AS i, count(*) AS nnz, sum(val) AS total "
        f"FROM t GROUP BY i{n}"
        for n in range(3)
    ),
    "mttkrp_4mode": _mttkrp(MARKET, 4, 0, 4),
    "mttkrp_5mode": _mttkrp_all(SUPPLY5, 5, 2),
    "events_mttkrp": _mttkrp(ACTIVITY, 3, 0, 4),
    "compare_factors": _compare(),
    "gram": f"{_outputs()} {_gram('y0')}",
    "hadamard_v": f"""{_outputs()}, g1 AS ({_gram('y1')}), g2 AS ({_gram('y2')})
      SELECT r, s, g1.g * g2.g AS g FROM g1 JOIN g2 USING (r, s)""",
    "sum_diag_product": f"""{_outputs()}, g0 AS ({_gram('y0')}), g1 AS ({_gram('y1')})
      SELECT round(sum(g0.g * g1.g) / 1e12, 3) AS total FROM g0 JOIN g1 USING (r, s) WHERE r = s""",
    "col_norms": f"""{_outputs()}
      SELECT CAST(r AS INTEGER) AS r, round(sqrt(sum(y * y)), 6) AS norm FROM y0 GROUP BY r""",
    "col_scale_inv": f"""{_outputs()},
      n AS (SELECT r, sqrt(sum(y * y)) AS norm FROM y0 GROUP BY r),
      z AS (SELECT i, y0.r AS r, CASE WHEN norm > 1e-20 THEN y / norm ELSE 0 END AS y
            FROM y0 JOIN n ON n.r = y0.r)
      SELECT i, {', '.join(f'round(f{r}, 6) + 0.0 AS f{r}' for r in range(4))}
      FROM ({_wide('SELECT * FROM z', 4, 'f')})""",
    "frob_norm_sq": f"{_outputs()} SELECT sum(y * y) AS norm_sq FROM y1",
    "weighted_col_dot": f"""{_outputs()}
      SELECT sum((y0.r + 1) * y0.y * f0.v) AS "inner" FROM y0 JOIN f0 ON f0.i = y0.i AND f0.r = y0.r""",
    "model_norm_sq": f"""{_outputs()},
      {', '.join(f"g{w} AS ({_gram(f'y{w}')})" for w in range(3))}
      SELECT round(log10(sum((r + 1) * (s + 1) * g0.g * g1.g * g2.g)), 9) AS log10_model_sq
      FROM g0 JOIN g1 USING (r, s) JOIN g2 USING (r, s)""",
    "als_rank1_update": f"""WITH t AS ({SUPPLY}), {_factors(3, 1)}, y AS ({_long(0, 3)})
      SELECT i, round(y / ((SELECT sum(v * v) FROM f1) * (SELECT sum(v * v) FROM f2)), 6) + 0.0 AS f0
      FROM y""",
    "als_rank2_update": _als_rank2(),
    "als_rank1_fit": _sweep_fits(2, 1),
    "als_rank1_fit_frames": _sweep_fits(2, 1),
    "als_rank2_fit": _sweep_fits(2, 2),
    "als_rank2_factors": _sweep_factors(2, 2),
    "jacobi_rank1_fit": _rank1_jacobi(),
    "cpals_gauss_seidel": _sweep_fits(2, 3),
    "cpals_jacobi": _sweep_fits(2, 2, True),
    "cpals_factors": _sweep_factors(2, 3),
    "factor_similarity": _similarity(2),
    "model_at_nonzeros": _model_at(),
    "residual_exact": _residual(),
    "morton_encode": f"{_morton()} SELECT i0, i1, i2, val, key FROM k",
    "morton_roundtrip": _T3,
    "morton_64bit": _morton_64(),
    "mttkrp_morton": _mttkrp_all(SUPPLY, 3, 4),
    "mttkrp_streamed": _mttkrp_all(SUPPLY, 3, 4),
    "tns_lines": f"""SELECT concat_ws(' ', i0 + 1, i1 + 1, i2 + 1, CAST(val AS BIGINT)) AS line
      FROM ({_summed(SUPPLY, 3)})""",
    "tns_parse": f"""SELECT CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1,
      CAST(i2 AS BIGINT) AS i2, val FROM ({SUPPLY})""",
    "tns_file_read": _T3,
    "cached_read": f"SELECT i0, i1, i2, val / 8 + 16777217 AS val FROM ({_T3})",
    "factor_binary_roundtrip": f"""{_outputs()},
      y AS ({_wide('SELECT * FROM y0', 4, 'f')}), n AS (SELECT unnest(range((SELECT max(i0) + 1 FROM t))) AS i)
      SELECT CAST(n.i AS BIGINT) AS i,
             {', '.join(f'CAST(CAST(coalesce(f{r}, 0) AS FLOAT) AS DOUBLE) AS f{r}' for r in range(4))}
      FROM n LEFT JOIN y ON n.i = y.i""",
    "factor_text_roundtrip": f"""{_outputs()},
      y AS ({_wide('SELECT * FROM y0', 4, 'f')}), n AS (SELECT unnest(range((SELECT max(i0) + 1 FROM t))) AS i)
      SELECT {', '.join(f'CAST(coalesce(f{r}, 0) AS DOUBLE) AS f{r}' for r in range(4))}
      FROM n LEFT JOIN y ON n.i = y.i""",
    "lambda_roundtrip": f"""{_outputs()}
      SELECT CAST(r AS INTEGER) AS r, CAST(CAST(round(sqrt(sum(y * y)), 6) AS FLOAT) AS DOUBLE) AS lambda
      FROM y0 GROUP BY r""".replace(" AS lambda", ' AS "lambda"'),
    "dnb_roundtrip": _T3,
    "saved_roundtrip": _T3,
    "packed_roundtrip": f"""SELECT CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1,
      CAST(i2 AS BIGINT) AS i2, val FROM ({_summed(SUPPLY, 3)})""",
}
