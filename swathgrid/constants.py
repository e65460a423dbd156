"""Fixed values of the data model (they must equal the published ones for right results)."""

LUNAR_RADIUS_M = 1_737_400
PIXELS_PER_DEGREE = 128
PATCH_SIZE = 256

# Photometric limits of a usable observation.
MAX_INCIDENCE_DEG = 80.0
MAX_EMISSION_DEG = 60.0
NODATA = -999.0

# Channel groups, in channel order.
CHANNEL_GROUPS = {
    "surface": ["wac_morphology", "elevation", "slope", "roughness"],
    "thermal": [
        "diviner_tbol_midnight",
        "diviner_temp_night",
        "rock_abundance",
        "christiansen_feature",
    ],
    "spectral_m3": [
        "m3_750",
        "m3_950",
        "m3_1000",
        "m3_1250",
        "m3_1580",
        "m3_2000",
        "m3_2817",
        "m3_2857",
    ],
    "gravity": ["grail_freeair", "grail_bouguer", "grail_uncertainty"],
    "radar": ["minirf_cpr", "minirf_s1"],
    "hapke": ["wac_hapke_415nm", "wac_hapke_566nm", "wac_hapke_604nm", "wac_hapke_689nm"],
    "composition": ["clementine_uvvis_750nm", "lpgrs_tio2", "lpgrs_feo"],
}
GROUP_NAMES = list(CHANNEL_GROUPS)
CHANNELS = [channel for members in CHANNEL_GROUPS.values() for channel in members]
CHANNEL_TO_GROUP = {c: g for g, members in CHANNEL_GROUPS.items() for c in members}

# Selected spectrometer bands, 0-based band number in the cube.
SPECTRAL_BANDS = {
    "m3_750": 8,
    "m3_950": 18,
    "m3_1000": 20,
    "m3_1250": 33,
    "m3_1580": 49,
    "m3_2000": 60,
    "m3_2817": 80,
    "m3_2857": 81,
}

# Expected physical range per channel (the twelve late channels have a range too).
VALUE_RANGES = {
    "wac_morphology": (0.0, 1.0),
    "elevation": (-9000.0, 11000.0),
    "slope": (0.0, 90.0),
    "roughness": (0.0, 5000.0),
    "diviner_tbol_midnight": (50.0, 300.0),
    "diviner_temp_night": (20.0, 300.0),
    "rock_abundance": (0.0, 1.0),
    "christiansen_feature": (7.0, 9.5),
    "m3_750": (0.0, 0.5),
    "m3_950": (0.0, 0.45),
    "m3_1000": (0.0, 0.45),
    "m3_1250": (0.0, 0.45),
    "m3_1580": (0.0, 0.40),
    "m3_2000": (0.0, 0.40),
    "m3_2817": (0.0, 0.35),
    "m3_2857": (0.0, 0.35),
    "grail_freeair": (-2000.0, 2000.0),
    "grail_bouguer": (-1000.0, 1000.0),
    "grail_uncertainty": (0.0, 50.0),
    "minirf_cpr": (0.0, 10.0),
    "minirf_s1": (0.0, 1e6),
    "wac_hapke_415nm": (0.0, 1.0),
    "wac_hapke_566nm": (0.0, 1.0),
    "wac_hapke_604nm": (0.0, 1.0),
    "wac_hapke_689nm": (0.0, 1.0),
    "clementine_uvvis_750nm": (0.0, 0.5),
    "lpgrs_tio2": (0.0, 0.2),
    "lpgrs_feo": (0.0, 0.4),
}

# Published (mean, standard deviation) per channel.
CHANNEL_STATS = {
    "wac_morphology": (63.93672180175781, 41.58778762817383),
    "elevation": (-456.82745361328125, 2291.07861328125),
    "slope": (7.696023941040039, 6.5508809089660645),
    "roughness": (37.071136474609375, 34.59404754638672),
    "diviner_tbol_midnight": (95.4284439086914, 6.590814590454102),
    "diviner_temp_night": (4.6754279136657715, 2.433091878890991),
    "rock_abundance": (0.0032689045183360577, 0.005054473411291838),
    "christiansen_feature": (8.172408103942871, 0.10063744336366653),
    "m3_750": (0.07985502481460571, 0.026131946593523026),
    "m3_950": (0.09297805279493332, 0.03190614655613899),
    "m3_1000": (0.09592405706644058, 0.03313419967889786),
    "m3_1250": (0.11663009226322174, 0.037944868206977844),
    "m3_1580": (0.13536937534809113, 0.042979899793863297),
    "m3_2000": (0.15935494005680084, 0.049484144896268845),
    "m3_2817": (0.20705363154411316, 0.0584820881485939),
    "m3_2857": (0.21383443474769592, 0.060030363500118256),
    "grail_freeair": (-4.5575480461120605, 128.3058319091797),
    "grail_bouguer": (21.076553344726562, 214.70179748535156),
    "grail_uncertainty": (1.9106417894363403, 1.6009092330932617),
    "minirf_cpr": (0.10053548961877823, 0.4787205755710602),
    "minirf_s1": (0.9580977559089661, 2.793243408203125),
    "wac_hapke_415nm": (0.025438349694013596, 0.007005367893725634),
    "wac_hapke_566nm": (0.03676752373576164, 0.009783195331692696),
    "wac_hapke_604nm": (0.03974344581365585, 0.01042565144598484),
    "wac_hapke_689nm": (0.04541388899087906, 0.01170538179576397),
    "clementine_uvvis_750nm": (41.5467414855957, 23.02393913269043),
    "lpgrs_tio2": (0.008645933121442795, 0.011847379617393017),
    "lpgrs_feo": (0.06930428743362427, 0.046127524226903915),
}

# Geology labels.
MARE_PREFIXES = ["Em", "Im", "lIm", "Cm"]
AGE_PREFIXES = [("pN", 0), ("EI", 2), ("N", 1), ("I", 2), ("E", 3), ("C", 4)]
TERRAIN_NAMES = {0: "highlands", 1: "mixed", 2: "mare", 3: "polar"}

# Registration check regions: name, centre latitude, centre longitude.
REGISTRATION_REGIONS = [
    ("Aristarchus", 23.7, -47.4),
    ("Copernicus", 9.6, -20.1),
    ("Tycho", -43.3, -11.2),
    ("Kepler", 8.1, -38.0),
    ("Proclus", 16.1, 46.8),
    ("Euler", 23.3, -29.2),
    ("Langrenus", -8.9, 61.0),
    ("Stevinus", -32.5, 54.1),
    ("Byrgius_A", -24.6, -63.7),
    ("Dionysius", 2.8, 17.3),
    ("Mare_Imbrium_edge", 32.0, -20.0),
    ("Mare_Serenitatis_edge", 25.0, 18.0),
    ("Mare_Crisium_edge", 17.0, 59.0),
    ("SPA_edge", -50.0, 170.0),
    ("Orientale_edge", -19.0, -95.0),
    ("Humboldt", -27.0, 80.6),
    ("Petavius", -25.3, 60.4),
    ("Clavius", -58.4, -14.4),
    ("Grimaldi", -5.2, -68.6),
    ("Plato", 51.6, -9.4),
]
REGISTRATION_WINDOW = 512
METRES_PER_PIXEL = 237.0

# Legacy archive prefixes and the prefix that replaced them.
ARCHIVE_PREFIXES = {
    "http://pds-imaging.jpl.nasa.gov/data/": "https://planetarydata.jpl.nasa.gov/img/data/",
    "https://pds-imaging.jpl.nasa.gov/data/": "https://planetarydata.jpl.nasa.gov/img/data/",
    "https://planetarydata.jpl.nasa.gov/data/": "https://planetarydata.jpl.nasa.gov/img/data/",
}

# ENVI header element codes.
ENVI_TYPES = {
    1: "u1",
    2: "i2",
    3: "i4",
    4: "f4",
    5: "f8",
    12: "u2",
    13: "u4",
    14: "i8",
    15: "u8",
}
# Known raster shapes (width, height) for files whose size disagrees with the label.
FALLBACK_SHAPES = [(46080, 23040), (11520, 5760)]

# Sample types of labels that mean the most significant byte first, beside all that name MSB.
BIG_ENDIAN_TYPES = ["IEEE_REAL", "SUN_REAL"]

# Column names tried, in order, when a crater list is read.
CRATER_COLUMNS = {
    "lat": ["LAT_CIRC_IMG", "LAT_ELLI_IMG", "Lat", "lat", "LATITUDE"],
    "lon": ["LON_CIRC_IMG", "LON_ELLI_IMG", "Lon", "lon", "LONGITUDE"],
    "diam_km": ["DIAM_CIRC_IMG", "DIAM_ELLI_MAJOR_IMG", "Diam", "diam", "DIAMETER"],
}
MIN_CRATER_KM = 10.0

# Element columns (0-based) of the whitespace table with abundance bins.
ABUNDANCE_COLUMNS = {"lpgrs_tio2": 11, "lpgrs_feo": 12}
ABUNDANCE_FIELDS = 15

# Download size estimates.
GB_PER_REFLECTANCE = 0.117
GB_PER_GEOMETRY = 0.515
MB_PER_STRIP = 440
