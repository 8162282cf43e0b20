"""Plain-Python versions of pipeline stages."""

import re
from collections import Counter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_lines(rows, ratio, least):
    """(id, host, text) to id -> text without lines on over ``ratio`` of a host's pages."""
    trim = lambda x: x.strip(" \t\r\x0b\x0c")
    pages, seen = Counter(h for _, h, _ in rows), Counter()
    for _, h, t in rows:
        seen.update((h, x) for x in {trim(x) for x in (t or "").split("\n")} if x)
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if (h, trim(x)) not in bad) for i, h, t in rows}


def brute_hits(text, items, n=10):
    words = " " + " ".join(WORD.findall((text or "").translate(LOW))) + " "
    for _, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            if " " + " ".join(w[i:i + n]) + " " in words:
                return True
    return False
