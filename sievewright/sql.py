"""SQL of the same derivations, in DuckDB's dialect, as the oracles' common tables."""

from __future__ import annotations

from .functions.categories import CATEGORIES
from .functions.expressions import SIGNALS
from .views import FRAME

DIMS = "d AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
SIGHTINGS = f"""{DIMS}, nv AS (SELECT count(*) AS n FROM embeddings), s AS (
    SELECT ev.event_id AS id, ev.user_id % 20 AS video_id, ev.user_id AS identity, epoch_us(ev.ts) / 1000000.0 AS t, ev.event_id AS ord, least(1.0, ev.value / 490.0) AS conf, d.e
    FROM events ev, nv, d WHERE d.id = (ev.user_id * 31 + floor(ev.value / 20)::BIGINT) % nv.n)"""


def e(i: int) -> str:
    return f"e[{i + 1}]"


def _blend(k: int) -> str:
    return f"least(1.0, 2.5 * abs({e(k)}))"


def _signals() -> str:
    out, k = [], 0
    for name, names in SIGNALS.items():
        out.append("(" + " + ".join(_blend(k + j) for j in range(len(names))) + f") / {float(len(names))} AS s_{name}")
        k += len(names)
    return ", ".join(out)


TAGS = """list_filter([
    CASE WHEN s_smile >= .70 AND s_jaw >= .20 THEN 'laughing' WHEN s_smile >= .70 THEN 'big_smile' WHEN s_smile >= .45 THEN 'confident_smile' WHEN s_smile >= .25 THEN 'slight_smile' END,
    CASE WHEN s_jaw >= .45 THEN 'mouth_open' WHEN s_jaw >= .20 AND s_smile < .45 THEN 'talking' END,
    CASE WHEN s_blink >= .55 THEN 'eyes_closed' END,
    CASE WHEN s_left >= .30 AND s_left > s_right THEN 'eyes_left' WHEN s_right >= .30 AND s_right > s_left THEN 'eyes_right' END,
    CASE WHEN s_down >= .30 AND s_down > s_up THEN 'looking_down' WHEN s_up >= .30 AND s_up > s_down THEN 'looking_up' END,
    CASE WHEN s_brow_up >= .35 THEN 'raised_eyebrows' END,
    CASE WHEN s_brow_down >= .30 OR s_frown >= .30 THEN 'frowning' END,
    CASE WHEN (s_brow_up + s_jaw + s_wide) / 3.0 >= .40 AND s_smile < .25 THEN 'surprised' END,
    CASE WHEN (s_press >= .35 OR s_squint >= .35 OR s_cheek >= .35) AND s_smile < .25 THEN 'focused' END,
    CASE WHEN s_smile < .25 AND s_jaw < .20 AND s_frown < .30 AND s_brow_down < .30 THEN CASE WHEN s_press >= .35 OR s_squint >= .35 OR s_cheek >= .35 THEN 'serious' ELSE 'neutral' END END
], lambda x: x IS NOT NULL)"""

BUCKET = """CASE WHEN abs(yaw) < 45 AND pitch >= 12 THEN 'looking_down' WHEN abs(yaw) < 45 AND pitch <= -12 THEN 'looking_up' WHEN abs(yaw) <= 15 THEN 'front'
    WHEN abs(yaw) <= 45 THEN CASE WHEN yaw < 0 THEN 'three_quarter_left' ELSE 'three_quarter_right' END ELSE CASE WHEN yaw < 0 THEN 'profile_left' ELSE 'profile_right' END END"""


def _category(pose: str | None, tags: list[str]) -> str:
    parts = ([f"pose = '{pose}'"] if pose else []) + (["list_has_any(tags, [" + ", ".join(f"'{t}'" for t in tags) + "])"] if tags else [])
    return " AND ".join(parts)


CATS = "list_filter([" + ", ".join(f"CASE WHEN {_category(p, t)} THEN '{n}' END" for n, p, t in CATEGORIES) + "], lambda x: x IS NOT NULL)"
CLIP = "least(1.0, greatest(0.0, {}))"


def looks(of: str, name: str = "k") -> str:
    """Common tables that give table `of` (e, conf and more) boxes, scores, pose, tags and cats, the last one named `name`."""
    w, h = FRAME
    return f"""
    {name}0 AS (SELECT *, trunc(abs({e(54)}) * 1500)::INT AS x, trunc(abs({e(55)}) * 800)::INT AS y, 20 + trunc(abs({e(56)}) * 400)::INT AS w, 20 + trunc(abs({e(57)}) * 400)::INT AS h,
        300.0 * {e(52)} AS yaw, 100.0 * {e(53)} AS pitch, {_signals()} FROM {of}),
    {name}1 AS (SELECT *, 4000.0 * abs({e(58)}) / (4000.0 * abs({e(58)}) + 350.0) AS sharpness,
        {CLIP.format(f"1.0 - 0.7 * least(1.0, (abs({e(59)}) / 4.0 + abs({e(60)}) / 4.0) * 3.0) - 0.3 * least(1.0, abs(128.0 + 400.0 * {e(61)} - 128.0) / 128.0)")} AS exposure,
        {CLIP.format("w * h / 48400.0")} AS face_resolution, conf AS landmark_confidence, 1.0 - least(1.0, abs({e(62)})) AS artifact,
        {CLIP.format(f"0.5 * (1.0 - CASE WHEN x <= 2 OR y <= 2 OR x + w >= {w} - 2 OR y + h >= {h} - 2 THEN 0.4 ELSE 0.0 END) + 0.5 * conf")} AS obstruction,
        {BUCKET} AS pose, {TAGS} AS tags0 FROM {name}0),
    {name}2 AS (SELECT *, CASE WHEN len(tags0) > 0 THEN tags0 ELSE ['neutral'] END AS tags,
        {CLIP.format("(0.30 * sharpness + 0.20 * exposure + 0.20 * face_resolution + 0.20 * landmark_confidence + 0.05 * artifact + 0.05 * obstruction) / 1.0")} AS quality FROM {name}1),
    {name} AS (SELECT *, {CATS} AS cats FROM {name}2)"""


def values(rows: list[tuple], columns: str) -> str:
    """An inline table t of Python values."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "t(" + columns + ") AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"
