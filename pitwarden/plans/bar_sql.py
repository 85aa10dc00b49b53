"""SQL of bars and bar features."""

from pitwarden.plans.sql import BRAND_TAPE, FIRST_PRICE, LAST_PRICE

RAW_BARS = f"""raw_bars AS (
  SELECT commodity, tick // 60 AS minute, {FIRST_PRICE} AS open, max(price) AS high, min(price) AS low,
    {LAST_PRICE} AS close, CAST(sum(quantity) AS DOUBLE) AS volume FROM trades GROUP BY 1, 2)"""

GRID = """grid AS (
  SELECT commodity, unnest(range(min(minute), max(minute) + 1)) AS minute FROM raw_bars GROUP BY commodity),
filled AS (
  SELECT g.commodity, g.minute, b.open, b.high, b.low, last_value(b.close IGNORE NULLS) OVER w AS close,
    coalesce(b.volume, 0.0) AS volume, 0 AS segment FROM grid g LEFT JOIN raw_bars b USING (commodity, minute)
  WINDOW w AS (PARTITION BY g.commodity ORDER BY g.minute)),
bars AS (
  SELECT commodity, minute, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low,
    close, volume, segment FROM filled)"""

BARS = [BRAND_TAPE, RAW_BARS, GRID]


def _t(x: str, n: int, fn: str, need: int = 1, lag: int = 0) -> str:
    frame = f"OVER (PARTITION BY commodity, segment ORDER BY minute ROWS BETWEEN {n - 1 + lag} PRECEDING AND {lag} PRECEDING)"
    call = f"quantile_cont({x}, 0.5) {frame}" if fn == "median" else f"{fn}({x}) {frame}"
    return call if need <= 1 else f"CASE WHEN count({x}) {frame} >= {need} THEN {call} END"


def _c(x: str, n: int, fn: str = "avg") -> str:
    return f"{fn}({x}) OVER (PARTITION BY commodity, segment ORDER BY minute ROWS BETWEEN {n // 2} PRECEDING AND {n // 2} FOLLOWING)"


def _base(x: str) -> str:
    return f"coalesce({_t(x, 60, 'median', 20, 1)}, quantile_cont({x}, 0.5) OVER (PARTITION BY commodity, segment))"


_O = "(PARTITION BY commodity, segment ORDER BY minute)"
_back = ", ".join(f"{_t('ret', k, 'sum')} AS back_{k}" for k in (3, 5, 10, 15, 30))
_fwd = ", ".join(
    f"coalesce(sum(ret) OVER (PARTITION BY commodity, segment ORDER BY minute ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING), 0.0) AS fwd_{k}"
    for k in (3, 5, 10, 15, 30))
_cs = ("coalesce(greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0.0), 0.0) * 1e4")
_phi_u = "(abs(zc) / sqrt(2.0::DOUBLE))"
_phi_t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * {_phi_u}))"
_poly = "(((((0.0::DOUBLE + 1.061405429::DOUBLE) * {t} + -1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} + -0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}".format(t=_phi_t)
_PHI = f"(0.5::DOUBLE * (1.0::DOUBLE + sign(zc) * (1.0::DOUBLE - ({_poly}) * exp(-{_phi_u} * {_phi_u}))))"

FEATURES = f"""f1 AS (
  SELECT commodity, segment, minute, open, high, low, close, volume AS vol, coalesce(ln(close) - ln(lag(close) OVER w), 0.0) * 1e4 AS ret,
    (high - low) / close * 1e4 AS rng, ln(high / low) AS hl, lag(high) OVER w AS high_1, lag(low) OVER w AS low_1, ln(1 + volume) AS lv,
    CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 1.0 END AS body_share
  FROM bars WINDOW w AS {_O}),
f1b AS (SELECT *, abs(ret) AS abs_ret, lag(ret) OVER w AS ret_1, lag(hl) OVER w AS hl_1 FROM f1 WINDOW w AS {_O}),
f1c AS (SELECT *, CASE WHEN hl_1 IS NULL THEN NULL ELSE
    (sqrt(2 * (hl * hl + hl_1 * hl_1)) - sqrt(hl * hl + hl_1 * hl_1)) / (3 - 2 * sqrt(2.0::DOUBLE))
    - sqrt(ln(greatest(high, high_1) / least(low, low_1)) * ln(greatest(high, high_1) / least(low, low_1)) / (3 - 2 * sqrt(2.0::DOUBLE))) END AS alpha
  FROM f1b),
f2 AS (
  SELECT *, greatest(coalesce({_t('ret', 60, 'stddev_samp', 20, 1)}, stddev_samp(ret) OVER (PARTITION BY commodity, segment), 0.5), 0.5) AS sigma,
    greatest({_base('rng')}, 0.1) AS rng_med, {_base('lv')} AS lv_med, greatest({_base('vol')}, 1.0) AS vmed, {_back}, {_fwd},
    {_t('rng', 5, 'avg')} AS rng_5, {_t('vol', 5, 'avg')} AS vol_5, {_t('vol', 15, 'avg')} AS vol_15, {_t('vol', 5, 'sum')} AS vsum_5,
    {_t('vol', 15, 'sum')} AS vsum_15, {_c('vol', 5, 'sum')} AS vsum_c5, {_c('vol', 15, 'sum')} AS vsum_c15,
    {_t('body_share', 5, 'avg')} AS body_5, {_t('close', 15, 'min')} AS lo_15, {_t('close', 15, 'max')} AS hi_15,
    {_t('close', 30, 'min')} AS lo_30, {_t('close', 30, 'max')} AS hi_30,
    {_t('CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END', 10, 'avg')} AS up_share_10,
    {_t('CASE WHEN vol <= 0 THEN 1.0 ELSE 0.0 END', 15, 'avg')} AS zero_vol_share_15,
    {_t('ret * ret_1', 15, 'avg', 5)} AS ac, {_t('ret * ret', 15, 'sum', 5)} AS rv1,
    {_t('abs_ret * abs(ret_1)', 15, 'sum', 5)} * (pi() / 2) AS bv,
    CASE WHEN count(ret) OVER x >= 5 AND stddev_samp(abs_ret) OVER x > 0 AND stddev_samp(vol) OVER x > 0
      THEN covar_samp(abs_ret, vol) OVER x / (stddev_samp(abs_ret) OVER x * stddev_samp(vol) OVER x) END AS pv, {_cs} AS cs
  FROM f1c WINDOW x AS (PARTITION BY commodity, segment ORDER BY minute ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
f3 AS (
  SELECT *, ret / sigma AS z, vol / vmed AS vrel, abs(lv - lv_med) AS lv_mad, rng / rng_med AS rrel,
    {_t('back_5 * back_5', 15, 'avg', 5)} * 3 AS rv5, greatest({_base('cs')}, 0.1) AS cs_med, {_c('cs', 5)} AS cs_c5 FROM f2),
f3b AS (SELECT *, abs(z) AS absz, greatest(least(z, 6.0), -6.0) AS zc FROM f3),
f3c AS (SELECT *, vol * (2 * {_PHI} - 1) AS signed FROM f3b),
f3d AS (SELECT *, signed / vmed AS sv, absz / greatest(vrel, 0.05) AS amihud, greatest({_base('lv_mad')} * 1.4826, 0.25) AS lv_scale FROM f3c),
f4 AS (
  SELECT *, {', '.join(f"{_c('vrel', k)} AS vrel_c{k}, {_c('absz', k)} AS absz_c{k}" for k in (5, 9, 15))}, {_c('rrel', 9)} AS range_c9,
    {_t('signed', 5, 'sum')} / greatest(vsum_5, 1.0) AS ofi_5, {_t('signed', 15, 'sum')} / greatest(vsum_15, 1.0) AS ofi_15,
    {_c('signed', 5, 'sum')} / greatest(vsum_c5, 1.0) AS ofi_c5, {_c('signed', 15, 'sum')} / greatest(vsum_c15, 1.0) AS ofi_c15,
    {_t('z * sv', 15, 'avg', 5)} AS zsv, {_t('z', 15, 'avg', 5)} AS mz, {_t('sv', 15, 'avg', 5)} AS msv, {_t('sv', 15, 'var_samp', 5)} AS vsv,
    {_c('amihud', 5)} AS amihud_c5, {_c('amihud', 9)} AS amihud_c9, greatest({_base('amihud')}, 0.05) AS a_med,
    {_t('absz', 60, 'avg', 20, 1)} AS mx, {_t('lv', 60, 'avg', 20, 1)} AS my, {_t('absz * lv', 60, 'avg', 20, 1)} AS mxy,
    {_t('absz', 60, 'var_samp', 20, 1)} AS vx FROM f3d),
f5 AS (SELECT *, coalesce(lv - (my + coalesce(CASE WHEN vx > 0 THEN (mxy - mx * my) / vx END, 0.0) * (absz - mx)), 0.0) AS vol_resid FROM f4),
f6 AS (SELECT *, {_c('vol_resid', 5)} AS vol_resid_c5, {_c('vol_resid', 9)} AS vol_resid_c9 FROM f5),
series AS (
  SELECT commodity, segment, minute, z AS ret_z_1,
    {', '.join(f"back_{k} / (sigma * sqrt({k}.0::DOUBLE)) AS ret_z_back_{k}, fwd_{k} / (sigma * sqrt({k}.0::DOUBLE)) AS ret_z_fwd_{k}" for k in (3, 5, 10, 15, 30))},
    rrel AS range_ratio, rng_5 / rng_med AS range_ratio_5, (lv - lv_med) / lv_scale AS vol_z,
    vol_5 / greatest(exp(lv_med) - 1, 1.0) AS vol_ratio_5, vol_15 / greatest(exp(lv_med) - 1, 1.0) AS vol_ratio_15, body_share,
    1.0 - body_5 AS wick_share_5, (lv - lv_med) / lv_scale - absz AS vol_per_move,
    ln(close / lo_15) * 1e4 / (sigma * sqrt(15.0::DOUBLE)) AS drawup_z_15, ln(hi_15 / close) * 1e4 / (sigma * sqrt(15.0::DOUBLE)) AS drawdown_z_15,
    -sign(back_5) * (fwd_5 / (sigma * sqrt(5.0::DOUBLE))) AS reversal_5, -sign(back_15) * (fwd_15 / (sigma * sqrt(15.0::DOUBLE))) AS reversal_15,
    up_share_10, CASE WHEN pv IS NULL OR isnan(pv) THEN 0.0 ELSE pv END AS pv_corr_15, zero_vol_share_15,
    vrel_c5, absz_c5, vrel_c9, absz_c9, vrel_c15, absz_c15, range_c9, ofi_5, ofi_c5, ofi_15, ofi_c15,
    greatest(least(coalesce(CASE WHEN vsv > 0 THEN (zsv - mz * msv) / vsv END, 0.0), 20.0), -20.0) AS kyle_15, amihud_c5,
    amihud_c9 / a_med AS amihud_ratio, greatest(least(coalesce(-ac / (sigma * sigma), 0.0), 5.0), -5.0) AS roll_ac_15, cs_c5 / cs_med AS cs_spread_c5,
    greatest(least(coalesce(rv5 / greatest(rv1, 1e-6), 1.0), 5.0), 0.0) AS var_ratio_15,
    CASE WHEN rv1 IS NULL OR bv IS NULL THEN 0.0 ELSE greatest(least((rv1 - bv) / greatest(rv1, 1e-6), 1.0), -1.0) END AS jump_share_15,
    vol_resid, vol_resid_c5, vol_resid_c9, CASE WHEN hi_30 > lo_30 THEN (close - lo_30) / (hi_30 - lo_30) ELSE 0.5 END AS pos_30
  FROM f6),
features AS (
  SELECT *, CASE WHEN count(*) OVER m > 2 THEN ret_z_back_5 - quantile_cont(ret_z_back_5, 0.5) OVER m ELSE ret_z_back_5 END AS xs_ret_z_5,
    CASE WHEN count(*) OVER m > 1 THEN CASE WHEN ret_z_back_5 >= 2 THEN sum((ret_z_back_5 >= 2)::INT) OVER m - 1
      WHEN ret_z_back_5 <= -2 THEN sum((ret_z_back_5 <= -2)::INT) OVER m - 1 ELSE 0 END / (count(*) OVER m - 1)::DOUBLE ELSE 0.0 END AS xs_comove_share
  FROM series WINDOW m AS (PARTITION BY minute))"""
