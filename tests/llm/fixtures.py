"""Small tables with nulls, empty and long texts, copies, near copies, repeated rows and clashing columns."""

import random

#: The columns of documents, and some whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, size long, key long, doc long"


def texts(seed: int = 7, n: int = 60) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): prose of invented words with exact and near copies and a shared passage."""
    pick = random.Random(seed)
    words = ["".join(pick.choice("aeioulnrst") for _ in range(pick.randint(1, 7))) for _ in range(400)]
    passage = " ".join(pick.choice(words) for _ in range(30))
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        body = [pick.choice(words) for _ in range(pick.choice([3, 12, 25, 60, 150]))]
        kind = i % 6
        if kind == 1 and out:
            body = (out[pick.randrange(len(out))][1] or "").split() or body  # an exact copy but for white space
        elif kind == 2 and out:
            body = (out[pick.randrange(len(out))][1] or "").split() or body
            body[pick.randrange(len(body))] = "Zz" + str(i)
        elif kind == 3:
            at = pick.randrange(len(body))
            body[at:at] = passage.split()
        out.append((i * 3, pick.choice([" ", "  ", "\n"]).join(body)))
    out += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "one two"), (1005, "Été où ça — 日本語 😀"), (1006, "a b " * 900)]
    return out


def rows(pairs) -> list[tuple]:
    return [(i, t, "en" if k % 3 else "fr", f"s{k % 2}", len(t or ""), 0.5, k, k, k, -k) for k, (i, t) in enumerate(pairs)]


def frame(spark, pairs):
    return spark.createDataFrame(rows(pairs), SCHEMA)
