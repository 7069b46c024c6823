"""Plain versions that the operators are held against."""

import hashlib
import re

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def license_places(text, phrases):
    w, out, labels = license_words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        out += at
        if at:
            labels.add(label)
    return w, sorted(out), ",".join(sorted(labels))


def license_labels(text, phrases, templates, share):
    """Labels, score and whether a block matched, over all runs of words up to a quarter longer than a template."""
    w, places, base = license_places(text, phrases)
    labels, best = set(filter(None, base.split(","))), 0.0
    for label, texts in templates.items():
        for template in texts:
            want, n = set(template.split()), len(template.split())
            runs = [set(w[i : i + n + n // 4]) for i in range(len(w))]
            most = max((len(want & r) for r in runs), default=0)
            if most >= share * len(want):
                labels.add(label)
                best = max(best, most / len(want))
    return ",".join(sorted(labels)), round(1.0 if places else best, 9), best > 0


def shingles(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.translate(LOWER)) if x]
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def near_components(texts, share=85, words=5):
    """texts: doc_id to text. doc_id to (set size, component id)."""
    sets = {k: shingles(v or "", words) for k, v in texts.items()}
    top = {k: k for k in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    by, ids = {}, sorted(sets)
    for k in ids:
        for s in sets[k]:
            by.setdefault(s, []).append(k)
    both = {}
    for group in by.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    for (a, b), n in both.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}
