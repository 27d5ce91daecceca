"""The flow against successive cheapest paths by plain relaxation, and its time on many patterns."""

import random
import time

from parlance.llm import mixing


def cheapest(patterns, quotas, copies):
    """(tokens, cost) of a flow built one token at a time along a cheapest path."""
    arcs = []  # from, to, capacity, price

    def arc(a, b, cap, price):
        arcs.append([a, b, cap, price])
        arcs.append([b, a, 0, -price])

    for p, (members, n) in patterns.items():
        for k in range(copies):
            arc("from", ("p", p), n, (k + 1) ** 2)
        for s in set(members):
            if s in quotas:
                arc(("p", p), ("s", s), 10**9, 0)
    for s, q in quotas.items():
        arc(("s", s), "to", q, 0)
    tokens = cost = 0
    while True:
        dist, via = {"from": 0}, {}
        for _ in range(2 + len(patterns) + len(quotas)):
            for i, (a, b, cap, price) in enumerate(arcs):
                if cap and a in dist and dist[a] + price < dist.get(b, 10**9):
                    dist[b], via[b] = dist[a] + price, i
        if "to" not in dist:
            return tokens, cost
        node = "to"
        while node != "from":
            arcs[via[node]][2] -= 1
            arcs[via[node] ^ 1][2] += 1
            node = arcs[via[node]][0]
        tokens, cost = tokens + 1, cost + dist["to"]


def test_cheapest_flow():
    rng = random.Random(3)
    for _ in range(60):
        sources = range(rng.randint(1, 5))
        patterns = {p: (rng.sample(range(6), rng.randint(0, 4)), rng.randint(0, 6)) for p in range(rng.randint(0, 7))}
        quotas = {s: rng.randint(0, 14) for s in sources}
        flow = mixing.route(patterns, quotas)
        used = {p: sum(f for (q, _), f in flow.items() if q == p) for p in patterns}
        cost = 0
        for p, f in used.items():
            n = patterns[p][1]
            assert f <= 3 * n
            cost += sum(min(n, f - k * n) * (k + 1) ** 2 for k in range(3) if f > k * n)
        for s, q in quotas.items():
            assert sum(f for (_, t), f in flow.items() if t == s) <= q
        assert all(s in patterns[p][0] for p, s in flow)
        assert (sum(flow.values()), cost) == cheapest(patterns, quotas, 3)


def test_many_patterns():
    rng = random.Random(5)
    patterns = {p: (rng.sample(range(40), rng.randint(1, 5)), rng.randint(1, 10**6)) for p in range(50_000)}
    total = sum(n for _, n in patterns.values())
    quotas = {s: int(total * w / 160) for s, w in enumerate([5, 2, 1] * 14) if s < 40}
    began = time.time()
    flow = mixing.route(patterns, quotas)
    assert time.time() - began < 120
    assert sum(flow.values()) <= sum(quotas.values())
    print(time.time() - began, sum(flow.values()) / sum(quotas.values()))
