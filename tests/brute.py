"""Definitions of matches, as plain loops."""


def extension(q, i, p, k):
    n = 0
    while i + n < len(q) and k + n < len(p) and q[i + n] == p[k + n]:
        n += 1
    return n


def long_matches(q, paths, least):
    out = []
    for s, p in paths.items():
        for i in range(len(q)):
            for k in range(len(p)):
                n = extension(q, i, p, k)
                if n >= least and (i == 0 or k == 0 or q[i - 1] != p[k - 1]):
                    out.append((i, n, s, k))
    return sorted(out)


def statistics(q, paths):
    return [max((extension(q, i, p, k) for p in paths.values() for k in range(len(p))), default=0) for i in range(len(q))]


def set_maximal(q, paths):
    m = statistics(q, paths)
    return sorted((i, m[i], s, k) for i in range(len(q)) if m[i] > 0 and (i == 0 or m[i] >= m[i - 1]) for s, p in paths.items() for k in range(len(p)) if extension(q, i, p, k) == m[i])


#: A small panel of haplotypes, with even nodes, and a query for its bidirectional form.
TOY = {0: [2, 4, 8, 10, 12, 16], 1: [2, 6, 8, 10, 12, 16], 2: [6, 8, 14, 16], 3: [2, 4, 8, 10, 12, 18], 4: [6, 8, 14, 14, 14, 14, 12, 18], 5: [2, 4, 4, 8, 10, 14, 18], 6: [2, 6, 8, 14, 18], 7: [6, 8, 14, 14, 14, 14, 18], 8: [2, 4, 8, 10, 12, 16], 9: [6, 8, 14, 14, 14, 18]}
QUERY = [17, 15, 15, 15, 15, 2, 4, 8, 14, 14, 14, 14, 14, 14, 14, 18]


def both_ways(paths):
    return {2 * h: p for h, p in paths.items()} | {2 * h + 1: [x ^ 1 for x in reversed(p)] for h, p in paths.items()}
