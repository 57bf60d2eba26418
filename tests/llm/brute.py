"""Plain versions of the operators' definitions, for small inputs."""

from collections import Counter


def _removed(docs, width):
    """For each sequence: which units a window covers that starts at two or more places."""
    seen = Counter()
    for d in docs:
        seen.update(tuple(d[i : i + width]) for i in range(len(d) - width + 1))
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if seen[tuple(d[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        yield gone


def _result(docs, width, join):
    """(units, units removed, maximal removed runs, what is kept) of each document."""
    for d, gone in zip(docs, _removed(docs, width)):
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        yield len(d), sum(gone), spans, join(u for u, g in zip(d, gone) if not g)


def byte_repeats(texts, width):
    return list(_result(texts, width, bytes))


def word_repeats(texts, width):
    return list(_result([t.split() for t in texts], width, b" ".join))
