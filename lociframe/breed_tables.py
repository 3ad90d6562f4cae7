"""Breed codes of the array panel → names of the trait table, and adult size by that name.

The names follow the trait table. A few names here have no partner in the size tables (and the other way round); the
joins drop them, and `scores.unmatched_codes` lists them. The full code → display name table is an input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Panel code → trait-table name.
TRAIT_NAMES = {
    "ACKR": "American Cocker Spaniels", "AFGH": "Afghan Hounds", "AIRT": "Airedale Terriers", "AKIT": "Akitas",
    "AMAL": "Alaskan Malamutes", "AMST": "American Staffordshire Terriers", "AHRT": "American Hairless Terriers",
    "ANAT": "Anatolian Shepherd Dogs", "AESK": "American Eskimo Dogs", "AUCD": "Australian Cattle Dogs",
    "AUST": "Australian Terriers", "AUSS": "Australian Shepherds", "AZWK_Mali": "Azawakhs", "BASS": "Basset Hounds",
    "BEAG": "Beagles", "BEDT": "Bedlington Terriers", "BELS": "Belgian Sheepdogs", "BELM": "Belgian Malinois",
    "TURV": "Belgian Tervuren", "BELT": "Belgian Tervuren", "BERD": "Bergamasco Sheepdogs", "BPIC": "Berger Picards",
    "BMAL": "Bernese Mountain Dogs", "BMD": "Bernese Mountain Dogs", "BICH": "Bichons Frises", "BLDH": "Bloodhounds",
    "BOER": "Boerboels", "BORD": "Border Collies", "BORT": "Border Terriers", "BORZ": "Borzois", "BOST": "Boston Terriers",
    "BOUV": "Bouviers des Flandres", "BOX": "Boxers", "BRIA": "Briards", "BRIT": "Brittanys", "BRTR": "Brittanys",
    "BRUS": "Brussels Griffons", "BSJI": "Basenjis", "BULD": "Bulldogs", "BULM": "Bullmastiffs", "BULT": "Bull Terriers",
    "MBLT": "Miniature Bull Terriers", "CAIR": "Cairn Terriers", "CANE": "Cane Corso", "CANE_Italy": "Cane Corso",
    "CARD": "Cardigan Welsh Corgis", "CKCS": "Cavalier King Charles Spaniels", "CCRT": "Retrievers (Curly-Coated)",
    "CHIH": "Chihuahuas", "CHIN": "Japanese Chin", "CRES": "Chinese Crested", "CHOW": "Chow Chows",
    "COOK": "Spaniels (Cocker)", "ESSP": "Spaniels (English Springer)", "COLL": "Collies", "SSHP": "Shetland Sheepdogs",
    "COTO": "Coton de Tulear", "DACH": "Dachshunds", "DALM": "Dalmatians", "DANE": "Great Danes",
    "DDBX": "Dogues de Bordeaux", "DEER": "Scottish Deerhounds", "DOBP": "Doberman Pinschers",
    "ECKR": "English Cocker Spaniels", "ESET": "Setters (English)", "FBUL": "French Bulldogs",
    "FCR": "Retrievers (Flat-Coated)", "FIEL": "Spaniels (Field)", "FINS": "Finnish Spitz", "WFOX": "Fox Terriers (Wire)",
    "GSD": "German Shepherd Dogs", "GSHP": "Pointers (German Shorthaired)", "GSNZ": "Giant Schnauzers",
    "GOLD": "Retrievers (Golden)", "GORD": "Setters (Gordon)", "GREY": "Greyhounds", "GREE": "Greyhounds",
    "GLEN": "Glen of Imaal Terriers", "GPYR": "Great Pyrenees", "GSMD": "Greater Swiss Mountain Dogs",
    "GWHP": "Pointers (German Wirehaired)", "HAVA": "Havanese", "HUSK": "Siberian Huskies", "IBIZ": "Ibizan Hounds",
    "ICES": "Icelandic Sheepdogs", "ISET": "Setters (Irish)", "IRIT": "Irish Terriers", "IWSP": "Spaniels (Irish Water)",
    "IWOF": "Irish Wolfhounds", "ITGY": "Italian Greyhounds", "JACK": "Russell Terriers", "KEES": "Keeshonden",
    "KERY": "Kerry Blue Terriers", "KOMO": "Komondorok", "KUVZ": "Kuvaszok", "LAB": "Retrievers (Labrador)",
    "LHSA": "Lhasa Apsos", "LEON": "Leonbergers", "MALT": "Maltese", "MAST": "Mastiffs", "MPOO": "Poodles",
    "MSNZ": "Miniature Schnauzers", "MPIN": "Miniature Pinschers", "NEAP": "Neapolitan Mastiffs", "NEWF": "Newfoundlands",
    "NORF": "Norfolk Terriers", "NSDT": "Retrievers (Nova Scotia Duck Tolling)", "OES": "Old English Sheepdogs",
    "OTTR": "Otterhounds", "PAPI": "Papillons", "PARS": "Parson Russell Terriers",
    "PBGV": "Petits Bassets Griffons Vendeens", "PEKE": "Pekingese", "PEMB": "Pembroke Welsh Corgis",
    "PHAR": "Pharaoh Hounds", "SPOO": "Poodles", "TPOO": "Poodles", "PTWD": "Portuguese Water Dogs", "POM": "Pomeranians",
    "PUG": "Pugs", "PULI": "Pulik", "PUMI": "Pumik", "RATT": "Rat Terriers", "RHOD": "Rhodesian Ridgebacks",
    "ROTT": "Rottweilers", "SALU": "Salukis", "SALU_ArabPen": "Salukis", "SALU_CentAsia": "Salukis",
    "SALU_Tribal": "Salukis", "SAMO": "Samoyeds", "SCOT": "Scottish Terriers", "SCWT": "Soft Coated Wheaten Terriers",
    "SHAR": "Chinese Shar-Pei", "SHIB": "Shiba Inu", "SHIH": "Shih Tzu", "SILK": "Silky Terriers", "SKIP": "Skye Terriers",
    "SLOU_NAfrica": "Sloughis", "SPIN": "Spinoni Italiani", "SSNZ": "Standard Schnauzers",
    "STAF": "Staffordshire Bull Terriers", "TIBS": "Tibetan Spaniels", "TIBT": "Tibetan Terriers",
    "TIBM": "Tibetan Mastiffs", "TIBM_China": "Tibetan Mastiffs", "TYFX": "Fox Terriers (Smooth)",
    "YORK": "Yorkshire Terriers", "VIZS": "Vizslas", "SVAL": "Swedish Vallhunds", "WEIM": "Weimaraners",
    "WHWT": "West Highland White Terriers", "WELS": "Spaniels (Welsh Springer)", "WHIP": "Whippets",
    "WHPG": "Wirehaired Pointing Griffons", "XOLO": "Xoloitzcuintli", "MXOL": "Xoloitzcuintli",
}

# Trait-table name, adult height at the withers in cm, adult weight in kg (None = not listed).
ADULT_SIZE = [
    ("Afghan Hounds", 68, 25), ("Airedale Terriers", 58, 24), ("Akitas", 65, 40), ("Alaskan Malamutes", 61, 38),
    ("Australian Cattle Dogs", 47, 20), ("Australian Shepherds", 52, 25), ("Basenjis", 42, 10), ("Basset Hounds", 33, 22),
    ("Beagles", 34, 9), ("Bearded Collies", 53, 22), ("Belgian Malinois", 60, 28), ("Belgian Sheepdogs", 61, 28),
    ("Belgian Tervuren", 61, 28), ("Bernese Mountain Dogs", 64, 40), ("Bichons Frises", 28, 5.5), ("Bloodhounds", 62, 45),
    ("Border Collies", 51, 17), ("Border Terriers", 33, 6), ("Borzois", 71, 35), ("Boston Terriers", 38, 8),
    ("Bouviers des Flandres", 64, 38), ("Boxers", 58, 30), ("Briards", 63, 35), ("Brittanys", 50, 16), ("Bulldogs", 38, 23),
    ("Bullmastiffs", 66, 55), ("Cairn Terriers", 28, 6.5), ("Cane Corso", 66, 50), ("Cardigan Welsh Corgis", 30, 14),
    ("Cavalier King Charles Spaniels", 31, 7), ("Retrievers (Chesapeake Bay)", 60, 30), ("Chihuahuas", 18, 2.5),
    ("Chinese Crested", 30, 5), ("Chinese Shar-Pei", 48, 22), ("Chow Chows", 48, 28), ("Spaniels (Cocker)", 37, 12),
    ("Collies", 61, 28), ("Retrievers (Curly-Coated)", 65, 32), ("Dalmatians", 56, 25), ("Doberman Pinschers", 66, 35),
    ("Dogues de Bordeaux", 63, 55), ("Spaniels (English Cocker)", 40, 13), ("Setters (English)", 63, 28),
    ("Spaniels (English Springer)", 50, 22), ("Retrievers (Flat-Coated)", 60, 32), ("French Bulldogs", 30, 11),
    ("German Shepherd Dogs", 62, 32), ("Pointers (German Shorthaired)", 60, 27), ("Pointers (German Wirehaired)", 63, 32),
    ("Retrievers (Golden)", 58, 30), ("Setters (Gordon)", 65, 28), ("Great Danes", 79, 65), ("Great Pyrenees", 71, 45),
    ("Greater Swiss Mountain Dogs", 67, 55), ("Greyhounds", 70, 30), ("Havanese", 23, 5), ("Ibizan Hounds", 60, 22),
    ("Setters (Irish)", 67, 30), ("Irish Terriers", 46, 12), ("Spaniels (Irish Water)", 57, 26), ("Irish Wolfhounds", 81, 55),
    ("Italian Greyhounds", 35, 4), ("Keeshonden", 46, 18), ("Kerry Blue Terriers", 47, 16), ("Komondorok", 70, 50),
    ("Kuvaszok", 70, 50), ("Retrievers (Labrador)", 57, 30), ("Leonbergers", 72, 55), ("Lhasa Apsos", 25, 6),
    ("Maltese", 23, 3), ("Mastiffs", 76, 90), ("Miniature Bull Terriers", 33, 11), ("Miniature Pinschers", 28, 4),
    ("Miniature Schnauzers", 32, 7), ("Newfoundlands", 69, 60), ("Norwegian Elkhounds", 50, 22),
    ("Retrievers (Nova Scotia Duck Tolling)", 50, 21), ("Old English Sheepdogs", 56, 34), ("Papillons", 23, 4),
    ("Parson Russell Terriers", 33, 6.5), ("Pembroke Welsh Corgis", 27, 12), ("Pomeranians", 18, 2.5), ("Poodles", 38, 8),
    ("Portuguese Water Dogs", 52, 21), ("Pugs", 30, 8), ("Rhodesian Ridgebacks", 64, 36), ("Rottweilers", 63, 48),
    ("Russell Terriers", 28, 5), ("Salukis", 66, 23), ("Samoyeds", 55, 24), ("Scottish Deerhounds", 76, 45),
    ("Shetland Sheepdogs", 37, 7), ("Shiba Inu", 38, 9), ("Shih Tzu", 25, 6), ("Siberian Huskies", 56, 22),
    ("Silky Terriers", 23, 4), ("Soft Coated Wheaten Terriers", 47, 16), ("Standard Schnauzers", 47, 17),
    ("Tibetan Mastiffs", 71, 60), ("Tibetan Spaniels", 25, 5), ("Tibetan Terriers", 38, 11), ("Vizslas", 58, 25),
    ("Weimaraners", 65, 32), ("Spaniels (Welsh Springer)", 46, 18), ("West Highland White Terriers", 27, 8),
    ("Whippets", 51, 12), ("Wirehaired Pointing Griffons", None, 27), ("Fox Terriers (Wire)", 38, 7.5),
    ("Yorkshire Terriers", 18, 3), ("Entlebucher Mountain Dogs", 50, 25),
]


def trait_names(spark: SparkSession) -> DataFrame:
    """code, name."""
    return spark.createDataFrame(list(TRAIT_NAMES.items()), "code string, name string")


def adult_sizes(spark: SparkSession) -> DataFrame:
    """breed_name, trait (height_cm or weight_kg), value as text, to be added to the trait table."""
    rows = [
        (name, trait, str(float(value)))
        for name, height, weight in ADULT_SIZE
        for trait, value in (("height_cm", height), ("weight_kg", weight))
        if value is not None
    ]
    return spark.createDataFrame(rows, "breed_name string, trait string, value string")
