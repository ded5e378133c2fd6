"""Plain versions of the operators on pairs, for small tables."""

import math
import re
from collections import defaultdict

import regex

from tidemill.llm import template_decontam


def low(text):
    """The words, A-Z in lower case."""
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^ \t-\r]+", text or "")]


def grams(text):
    w = low(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def like(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def groups(texts):
    """For each place in texts: the places that it is linked to, and the least place of its group."""
    sets, links, group = [grams(t) for t in texts], defaultdict(set), list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if like(sets[a], sets[b]):
                links[a].add(b), links[b].add(a)
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return [links[i] for i in range(len(texts))], [find(i) for i in range(len(texts))]


def without_windows(rows, size=50):
    """rows (id, text), ascending: their words without each window of size words that an earlier row has."""
    seen, out = set(), []
    for _, text in rows:
        w = low(text)
        own = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        gone = {i for k, x in enumerate(own) if x in seen for i in range(k, k + size)}
        out.append([x for i, x in enumerate(w) if i not in gone])
        seen.update(own)
    return out


def template(text):
    text = regex.sub(r"(?a)(?<!\S)[^\s\d]*+\d\S*+", "<num>", text)
    text = regex.sub(r"(?a)(?<!\S)\p{Lu}\S*+", "<name>", text)
    return regex.sub(r"(?a)<num>(\s+)(?:" + "|".join(template_decontam.UNITS) + r")(?!\S)", r"<num>\1<unit>", text)


def leak(text, item):
    """None, or what template_decontam says of a text and an item that has a usable template window: (matched, windows, slot values, consistent, reparameterised)."""
    windows = lambda t: [(k, tuple(w[k : k + 8]), [b for a, b in zip(w[k : k + 8], o[k : k + 8], strict=True) if a[0:1] == "<"]) for w, o in [(regex.split(r"(?a)\s+", template(t)), regex.split(r"(?a)\s+", t))] for k in range(len(w) - 7)]
    own = {}
    for k, tokens, slots in windows(item):
        if sum(not t.startswith("<") for t in tokens) >= 4:
            own.setdefault(tokens, (k, slots))
    met = defaultdict(dict)
    for k, tokens, values in windows(text):
        if tokens in own:
            shift = k - own[tokens][0]
            for occurrence in [(0,), (1, shift), *((w, part, math.floor((shift + part * (w // 2)) / w)) for w in (4, 16) for part in (0, 1))]:
                met[occurrence].setdefault(tokens, values)
    bare = lambda x: regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", x)
    best = None
    for found in met.values():
        if len(found) >= 0.5 * len(own):
            stands = defaultdict(set)
            for tokens, values in found.items():
                for slot, value in zip(own[tokens][1], values, strict=True):
                    stands[bare(slot)].add(bare(value))
            consistent = sum(len(v) == 1 for v in stands.values())
            changed = any(v != {s} for s, v in stands.items())
            if consistent >= 0.75 * len(stands):
                judged = (len(found), consistent, not changed, len(stands))
                best = max(best or judged, judged)
    return best and (best[0], len(own), best[3], best[1], not best[2])
