"""Documents with every oddity at once: nulls, empties, repeated rows, ties, long texts, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, body_ string, doc long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    said = ["".join(r.choice(("ta", "re", "mi", "on", "es", "lo", "é", "ar")) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(said))


def rows() -> list[tuple]:
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(2, 30)
    texts = [
        (0, base), (1, near), (2, base), (2, base), (3, None), (4, ""), (5, "   \n\t "), (6, "one two"), (7, "ONE\ttwo"), (8, prose(3, 80) + " " + passage), (9, passage + "\n" + prose(4, 50)),
        (10, prose(5, 3000)), (11, "x" * 5000), (12, "\n".join(["same line of words here."] * 6) + "\n" + prose(6, 40)), (13, " ".join(w + "###" for w in prose(7, 60).split())),
        (14, " | ".join(prose(8, 40).split())), (15, prose(9, 40) + "\nAll rights reserved."), (16, " ".join([prose(10, 8)] * 20)), (None, prose(11, 30)), (17, prose(12, 49)[:49]), (18, prose(13, 400)),
    ]
    return [(i, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t or ""), 7, False, "b", -1) for k, (i, t) in enumerate(texts)]
