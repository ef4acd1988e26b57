"""An exact similarity self-join of sets by prefix filtering, for tables too large for all pairs.

Elements are ordered by how rare they are.  Two sets of similarity 0.8 have an element in common among
their first n - ceil(0.8 n) + 1, so sets that share none of these are no pair; the others are
compared unless they are connected already.
"""

from collections import Counter, defaultdict


def least_reachable(sets, percent=80):
    """For each set the number of the smallest one that links of 100 * intersection >= percent * union reach."""
    often = Counter(x for s in sets for x in s)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    postings = defaultdict(list)
    for i in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        own = sets[i]
        n = len(own)
        if not n:
            continue
        first = sorted(own, key=lambda x: (often[x], x))[: n - -(-percent * n // 100) + 1]
        seen = set()
        for x in first:
            for j in postings[x]:
                if j in seen:
                    continue
                seen.add(j)
                if 100 * len(sets[j]) < percent * n:
                    continue
                a, b = find(i), find(j)
                if a != b:
                    both = len(own & sets[j])
                    if 100 * both >= percent * (n + len(sets[j]) - both):
                        parent[max(a, b)] = min(a, b)
            if often[x] > 1:
                postings[x].append(i)
    return [find(i) for i in range(len(sets))]
