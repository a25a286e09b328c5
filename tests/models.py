"""Plain Python models of the semantics, used as differential oracles on small fixtures."""

import random
import statistics


def line(u):
    return f"{u[0]}: {u[1]}"


def windows(utts, budget):
    out, cur, used, start = [], [], 0, 0
    for i, u in enumerate(utts):
        text = line(u)
        n = len(text.split())
        if cur and used + n > budget:
            out.append((start, i - 1, "\n".join(cur)))
            cur, used, start = [], 0, i
        cur.append(text)
        used += n
    if cur:
        out.append((start, len(utts) - 1, "\n".join(cur)))
    return out


def pack(scored, budget):
    """scored: (score, start, words); returns the starts picked, in order."""
    picked, used = [], 0
    for _, start, n in sorted(scored, reverse=True):
        if picked and used + n > budget:
            continue
        picked.append(start)
        used += n
        if used >= budget:
            break
    return sorted(picked)


def bootstrap(a, b, draws, seed):
    rng = random.Random(seed)
    n, diffs, wins = len(a), [], 0
    for _ in range(draws):
        idx = [rng.randrange(n) for _ in range(n)]
        ma, mb = sum(a[i] for i in idx) / n, sum(b[i] for i in idx) / n
        diffs.append(mb - ma)
        wins += mb > ma
    diffs.sort()
    return diffs[int(0.025 * draws)], diffs[int(0.975 * draws) - 1], wins / draws


def median(xs):
    return statistics.median(xs)
