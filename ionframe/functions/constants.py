"""Fixed values of the domain: masses, modifications, mass tags, substitutions, constants of scores."""

from __future__ import annotations

PROTON = 1.007276466621
WATER = 18.0105646837
ISOTOPE_STEP = 1.0033548378  # mass of a C-13 atom less that of a C-12 atom

# Monoisotopic residue masses.
RESIDUE_MASS = {
    "G": 57.02146372, "A": 71.03711379, "S": 87.03202841, "P": 97.05276385, "V": 99.06841392, "T": 101.04767847, "C": 103.00918448, "L": 113.08406398, "I": 113.08406398, "N": 114.04292745,
    "D": 115.02694303, "Q": 128.05857751, "K": 128.09496302, "E": 129.04259309, "M": 131.04048461, "H": 137.05891186, "F": 147.06841392, "R": 156.10111103, "Y": 163.06332853, "W": 186.07931295,
}

# Elemental composition of residues (C, H, N, O, S).
RESIDUE_ATOMS = {
    "G": (2, 3, 1, 1, 0), "A": (3, 5, 1, 1, 0), "S": (3, 5, 1, 2, 0), "P": (5, 7, 1, 1, 0), "V": (5, 9, 1, 1, 0), "T": (4, 7, 1, 2, 0), "C": (3, 5, 1, 1, 1), "L": (6, 11, 1, 1, 0), "I": (6, 11, 1, 1, 0), "N": (4, 6, 2, 2, 0),
    "D": (4, 5, 1, 3, 0), "Q": (5, 8, 2, 2, 0), "K": (6, 12, 2, 1, 0), "E": (5, 7, 1, 3, 0), "M": (5, 9, 1, 1, 1), "H": (6, 7, 3, 1, 0), "F": (9, 9, 1, 1, 0), "R": (6, 12, 4, 1, 0), "Y": (9, 9, 1, 2, 0), "W": (11, 10, 2, 1, 0),
}

# Natural abundances by nominal mass above the lightest isotope.
ISOTOPES = {"C": (0.9893, 0.0107), "H": (0.999885, 0.000115), "N": (0.99632, 0.00368), "O": (0.99757, 0.00038, 0.00205), "S": (0.9493, 0.0076, 0.0429, 0.0, 0.0002)}

# Atoms (C, H, N, O, S) that frequent modifications add, by UniMod number.
MOD_ATOMS = {"UniMod:4": (2, 3, 1, 1, 0), "UniMod:35": (0, 0, 0, 1, 0), "UniMod:1": (2, 2, 0, 1, 0), "UniMod:7": (0, -1, -1, 1, 0), "UniMod:5": (1, 1, 1, 1, 0), "UniMod:27": (0, -2, 0, -1, 0), "UniMod:28": (0, -3, -1, 0, 0), "UniMod:121": (4, 6, 2, 2, 0)}

# Neutral losses.
LOSS_MASS = {"H2O": 18.0105646837, "NH3": 17.0265491015, "CO": 27.9949146221, "H3PO4": 97.9768950}

# Monoisotopic mass shifts of modifications by name.
MODIFICATION_MASS = {
    "UniMod:4": 57.021464,
    "Carbamidomethyl (C)": 57.021464,
    "Carbamidomethyl": 57.021464,
    "CAM": 57.021464,
    "+57": 57.021464,
    "+57.0": 57.021464,
    "UniMod:26": 39.994915,
    "PCm": 39.994915,
    "UniMod:5": 43.005814,
    "Carbamylation (KR)": 43.005814,
    "+43": 43.005814,
    "+43.0": 43.005814,
    "CRM": 43.005814,
    "UniMod:7": 0.984016,
    "Deamidation (NQ)": 0.984016,
    "Deamidation": 0.984016,
    "Dea": 0.984016,
    "+1": 0.984016,
    "+1.0": 0.984016,
    "UniMod:35": 15.994915,
    "Oxidation (M)": 15.994915,
    "Oxidation": 15.994915,
    "Oxi": 15.994915,
    "+16": 15.994915,
    "+16.0": 15.994915,
    "UniMod:1": 42.010565,
    "Acetyl (Protein N-term)": 42.010565,
    "+42": 42.010565,
    "+42.0": 42.010565,
    "UniMod:255": 28.0313,
    "AAR": 28.0313,
    "UniMod:254": 26.01565,
    "AAS": 26.01565,
    "UniMod:122": 27.994915,
    "Frm": 27.994915,
    "UniMod:1301": 128.094963,
    "+1K": 128.094963,
    "UniMod:1288": 156.101111,
    "+1R": 156.101111,
    "UniMod:27": -18.010565,
    "PGE": -18.010565,
    "UniMod:28": -17.026549,
    "PGQ": -17.026549,
    "UniMod:526": -48.003371,
    "DTM": -48.003371,
    "UniMod:325": 31.989829,
    "2Ox": 31.989829,
    "UniMod:342": 15.010899,
    "Amn": 15.010899,
    "UniMod:1290": 114.042927,
    "2CM": 114.042927,
    "UniMod:359": 13.979265,
    "PGP": 13.979265,
    "UniMod:30": 21.981943,
    "NaX": 21.981943,
    "UniMod:401": -2.01565,
    "-2H": -2.01565,
    "UniMod:528": 14.999666,
    "MDe": 14.999666,
    "UniMod:385": -17.026549,
    "dAm": -17.026549,
    "UniMod:23": -18.010565,
    "Dhy": -18.010565,
    "UniMod:129": 125.896648,
    "Iod": 125.896648,
    "Phosphorylation (ST)": 79.966331,
    "UniMod:21": 79.966331,
    "+80": 79.966331,
    "+80.0": 79.966331,
    "UniMod:259": 8.014199,
    "Lys8": 8.014199,
    "UniMod:267": 10.008269,
    "Arg10": 10.008269,
    "UniMod:268": 6.013809,
    "UniMod:269": 10.027228,
}

# Mass tags as (rules, base mass, {channel: shift over the base}).
MASS_TAGS: dict[str, tuple[str, float, dict[str, float]]] = {
    "mTRAQ": ("nK", 140.0949630177, {"0": 0.0, "4": 4.0070994, "8": 8.0141988132}),
    "mTRAQ_678": ("nK", 140.0949630177, {"6": 6.0074891, "7": 7.010844, "8": 8.0141988132}),
    "mTRAQ_02468": ("nK", 140.0949630177, {"0": 0.0, "2": 2.0003897, "4": 4.0070994, "6": 6.0074891, "8": 8.0141988132}),
    "diethyl_6plex": ("nK", 56.06260026, {"0": 0.0, "2": 2.01255348, "4": 4.013419349, "6": 6.025972839, "8": 8.05021396, "10": 10.062767459}),
    "diethyl_3plex": ("nK", 56.06260026, {"0": 0.0, "4": 4.013419349, "8": 8.05021396}),
    "tag6": ("nK", 308.1160923903, {"0": 0.0}),
    "tag6_5plex": ("nK", 308.1160923903, {"0": 0.0, "4": 4.01095605604, "8": 8.0268387024, "12": 12.0339381092, "16": 16.03857422084}),
    "tag6_9plex": ("nK", 308.1160923903, {"0": 0.0, "2": 2.0067096756, "4": 4.01095605604, "6": 6.0201290268, "8": 8.0268387024, "10": 10.03108508284, "12": 12.0339381092, "14": 14.0406477848, "16": 16.03857422084}),
    "tag6_d0d2": ("nK", 308.1160923903, {"0": 0.0, "2": 2.0067096756}),
    "tag6_d0d4": ("nK", 308.1160923903, {"0": 0.0, "4": 4.01095605604}),
    "tag6_d0d2d4": ("nK", 308.1160923903, {"0": 0.0, "2": 2.0067096756, "4": 4.01095605604}),
    "tag6lys": ("nK", 464.24235, {"0": 0.0}),
    "tag6arg": ("nK", 464.2172, {"0": 0.0}),
    "tag6pip": ("nK", 434.1954, {"0": 0.0}),
    "ProtSci_light_plex": ("nK", 0.0, {"4": 328.231941371, "8": 332.232721371, "12": 336.246141371, "16": 340.246860336, "20": 344.260280336}),
    "ProtSci_heavy_plex": ("nK", 0.0, {"4": 328.231941371, "8": 332.232721371, "12": 336.246141371, "16": 340.246860336, "20": 344.260280336}),
    "SILAC": ("R", 0.0, {"10": 10.008269}),
}

# Residue substitutions of the substituting decoy rule.
SUBSTITUTE = {
    "G": "L", "A": "L", "V": "L", "L": "V", "I": "V", "F": "L", "M": "L", "P": "L", "W": "L", "S": "T",
    "C": "S", "T": "S", "Y": "S", "H": "S", "K": "L", "R": "L", "Q": "N", "E": "D", "N": "Q", "D": "E",
}
