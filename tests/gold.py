"""A slow sequential twin of the calling pipeline for small inputs, by plain loops."""

import math

GENOTYPES = [0, 1, 2, 3, 5, 6, 7, 10, 11, 15]
CODE = {"A": 0, "C": 1, "T": 2, "G": 3}


def site(observations, ref, p, cap=255, het=0.001, hom=0.0005, log_pcr=math.log10(0.5), log_global=math.log10(0.9)):
    """``observations``: (base, q, cycle, strand, hit) in order of arrival; ``p``: p(q, cycle, true, observed). Gives counts,
    best bases, genotypes and quality of one site."""
    depth = repeat = dep = 0
    uni, qs, every, kept = [0] * 4, [0] * 4, [0] * 4, []
    for base, q, cycle, strand, hit in observations:
        depth += 1
        repeat += hit
        if base is None or q < 0 or dep >= cap:
            continue
        every[base] += 1
        if hit == 1:
            dep += 1
            uni[base] += 1
            qs[base] += q
            kept.append((base, -q, cycle, strand))
    lik = dict.fromkeys(GENOTYPES, 0.0)
    for b in range(4):
        seen, distinct = {}, -1
        for base, minus, cycle, strand in sorted(kept):
            if base != b:
                continue
            n = seen.get((strand, cycle), 0)
            if n == 0:
                distinct += 1
            seen[strand, cycle] = n + 1
            q = -minus
            adjusted = 1 if q == 0 else max(1, int(10 ** (math.log10(q) + n * log_pcr + distinct * log_global) + 0.5))
            for g in GENOTYPES:
                lik[g] += math.log10(0.5 * p(adjusted, cycle, g >> 2, b) + 0.5 * p(adjusted, cycle, g & 3, b))

    def ranked(values):
        return sorted(((v, b) for b, v in enumerate(values)), reverse=True)

    order = ranked(qs if dep else every)
    base1, base2 = order[0][1], order[1][1]
    if order[0][0] == 0:
        base1 = ref
    elif order[1][0] == 0 and base1 != ref:
        base2 = ref
    quals = [order[k][0] if dep else -1 - k for k in range(3)]

    def prior(g):
        a, b = g >> 2, g & 3
        if ref >= 4:
            return (1 if a == b else 2 * het) / 16
        own = (a == ref) + (b == ref)
        return 1 if own == 2 else het if own else hom if a == b else het * hom

    posts = sorted(((round(lik[g], 9) + math.log10(prior(g)), g) for g in GENOTYPES), reverse=True)
    (lp1, type1), (lp2, type2) = posts[:2]
    quality = int(10 * (lp1 - lp2) + 1e-9)
    a, b = type1 >> 2, type1 & 3
    if a == b:
        quality = 0 if quals[0] > 0 and base1 != a else min(quality, quals[0] - quals[1])
    elif base1 < 4 and base2 < 4 and qs[base1] > 0 and qs[base2] > 0 and sorted((base1, base2)) == [a, b]:
        quality = min(quality, quals[1] - quals[2])
    else:
        quality = 0
    return {"depth": depth, "repeat_time": repeat, "dep_uni": dep, "uni": uni, "qs": qs, "all": every, "base1": base1, "base2": base2, "type1": type1, "type2": type2, "quality": max(0, min(99, quality))}
