"""Small tables with everything in them that operators must survive."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHING = ["id", "row", "rk", "fp", "node", "kept", "score", "starts", "gone", "n", "count", "part", "length", "ids"]

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "und", "été", "ção", "日本", "x1", "A", "b"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def messy_rows(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages and lines, missing ids and texts, repeated rows."""
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = []
    line, passage = sentence(rng, 12), sentence(rng, 30)
    for i in range(40):
        lines = [sentence(rng, rng.choice([0, 1, 2, 9, 25, 60])) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), line)
        if i % 4 == 0:
            lines.append(f"{sentence(rng, 4)} {passage} {sentence(rng, 3)}")
        rows.append((i, "\n".join(lines)))
    long = sentence(rng, 120)
    rows += [(100 + i, long) for i in range(6)]
    rows += [(120 + i, edited(rng, long, 1 + i % 3)) for i in range(12)]
    rows += [(200, rows[3][1].replace(" ", "  ")), (201, " " + rows[5][1]), (202, rows[5][1].upper())]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, None), (304, ".!?"), (305, "one"), (306, "one two")]
    rows += [(None, long), (None, "alone without an id"), (None, "alone without an id"), (None, None)]
    rows += [rows[0], rows[0], (1, rows[2][1]), (7, "the same id, another text")]
    rng.shuffle(rows)
    return rows


def documents(spark: SparkSession, rows, clashing: bool = True, parts: int = 3) -> DataFrame:
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, COLUMNS).repartition(parts)
    if clashing:
        for name in CLASHING:
            df = df.selectExpr("*", f"'{name} of the row' AS `{name}`")
        df = df.selectExpr("*", "1 AS `a.b`", "'x' AS `odd name`")
    return df


def groups(pairs, nodes) -> dict:
    """The smallest node that each one reaches."""
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
