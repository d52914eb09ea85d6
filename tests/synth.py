"""A synthetic run: peptides, library and scans with known abundances."""

from __future__ import annotations

import numpy as np

from ionframe.functions.constants import PROTON, RESIDUE_MASS, WATER


def run(peptides: int = 60, cycles: int = 40, windows: int = 6, seed: int = 1, ppm: float = 3.0, noise: int = 30, shift: float = 0.0, drift: float = 0.0):
    """(library rows, scan rows, truth rows) as plain tuples; peptides end in K or R, and elute as Gaussians. shift: all peaks are seen so many ppm too high; drift: ppm
    more from the run's start to its end."""
    r = np.random.default_rng(seed)
    letters = "ADEFGHILNPQSTVWY"
    library, chosen, seen = [], [], set()
    while len(chosen) < peptides:
        seq = "".join(r.choice(list(letters), r.integers(7, 14))) + str(r.choice(list("KR")))
        if seq in seen:
            continue
        seen.add(seq)
        masses = np.array([RESIDUE_MASS[x] for x in seq])
        mz = (masses.sum() + WATER) / 2 + PROTON
        b, y = np.cumsum(masses)[:-1] + PROTON, np.cumsum(masses[::-1])[:-1] + WATER + PROTON
        frags = [(float(m), float(r.uniform(0.1, 1)), f"{ion}{i + 1}_1") for ion, ms in (("b", b), ("y", y)) for i, m in enumerate(ms) if i > 0]
        chosen.append((seq, mz, float(r.uniform(2, 18)), frags, float(10 ** r.uniform(3, 5))))
        library.append((seq, 2, float(mz), chosen[-1][2], sorted(frags)))
    lo, hi = min(p[1] for p in chosen) - 1, max(p[1] for p in chosen) + 1
    edges = np.linspace(lo, hi, windows + 1)
    scans, truth, number = [], [], 0
    for c in range(cycles):
        rt = 20 * c / cycles
        number += 1
        ms1 = [(p[1] * (1 + r.normal(0, ppm * 1e-6)), p[4] * np.exp(-((rt - p[2]) ** 2) / 0.5)) for p in chosen]
        scans.append(("run", number, 1, rt, ms1, None, None, None))
        for w in range(windows):
            number += 1
            peaks = [(float(m), float(i)) for m, i in zip(r.uniform(100, 1200, noise), r.uniform(1, 20, noise), strict=True)]
            for k, (_, mz, at, frags, amount) in enumerate(chosen):
                level = amount * np.exp(-((rt - at) ** 2) / 0.5)
                if edges[w] <= mz < edges[w + 1] and level > 50:
                    total = sum(f[1] for f in frags)
                    peaks += [(m * (1 + r.normal(0, ppm * 1e-6 / 3)), level * i / total) for m, i, _ in frags]
                    truth.append((k, number, float(level)))
            scans.append(("run", number, 2, rt + 0.01 * (w + 1), peaks, float((edges[w] + edges[w + 1]) / 2), float(edges[w]), float(edges[w + 1])))
    rows = []
    for name, n, level, rt, peaks, target, a, b in scans:
        off = 1 + (shift + drift * (rt / 20 - 0.5)) * 1e-6
        peaks = sorted((float(m * off), float(i)) for m, i in peaks if i > 0)
        rows.append((name, n, level, float(rt), sum(i for _, i in peaks), target, a, b, [m for m, _ in peaks], [i for _, i in peaks]))
    return library, rows, truth


LIBRARY = "mod_seq string, charge int, prec_mz double, irt double, frags array<struct<mz:double,intensity:double,name:string>>"
SCANS = "run string, scan_num long, ms_level int, rt double, tic double, prec_mz double, win_lo double, win_hi double, mz array<double>, intensity array<double>"
