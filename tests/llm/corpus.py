"""A small corpus with the awkward cases, and brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{k}" for k in range(400)] + ["Der", "été", "ß", "日本", "a", "the"]


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def documents(seed: int = 5) -> list[tuple]:
    rnd = random.Random(seed)
    texts: list[str | None] = [prose(rnd, rnd.randint(1, 120)) for _ in range(60)]
    passage, other = prose(rnd, 60), prose(rnd, 14)
    for _ in range(12):
        texts.append(prose(rnd, rnd.randint(0, 30)) + " " + passage + "\n" + prose(rnd, rnd.randint(0, 30)))
        texts.append(prose(rnd, rnd.randint(0, 9)) + "  " + other + "\t" + prose(rnd, 5))
    long = prose(rnd, 400)
    for k in range(10):  # near copies
        w = long.split(" ")
        w[37 * k % 400] = "edit"
        texts.append(" ".join(w))
    texts += [None, "", "   \n\t", "one", "one two", "one two three", "same same same same same same same same same same same same same same same"]
    texts += [texts[3]] * 4 + [passage] * 3 + [passage.upper()]
    texts += ["\x0bpart\x0cs\x1c   " + prose(rnd, 20), "x" * 5000 + " " + prose(rnd, 3000)]
    return [(k, t, "en", [None, "b", "a", "", "c"][k % 5], None if t is None else len(t)) for k, t in enumerate(texts)]


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
