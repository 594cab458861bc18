"""Fixed values of the code systems: published tables that results depend on, as text in their natural order."""

from __future__ import annotations

# Points of the hospital frailty risk score by three-character ICD-10 cluster (fixed values, published table of 109 clusters).
HFRS_TEXT = """
A04 1.1 A09 1.1 A41 1.6 B95 1.7 B96 2.9 D64 0.4 E05 0.9 E16 1.4 E53 1.9 E55 1.0 E83 0.4 E86 2.3 E87 2.3 F00 7.1 F01 2.0
F03 2.1 F05 3.2 F10 0.7 F32 0.5 G20 1.8 G30 4.0 G31 1.2 G40 1.5 G45 1.2 G81 4.4 H54 1.9 H91 0.9 I63 0.8 I67 2.6 I69 3.7
I95 1.6 J18 1.1 J22 0.7 J69 1.0 J96 1.5 K26 1.6 K52 0.3 K59 1.8 K92 0.8 L03 2.0 L08 0.4 L89 1.7 L97 1.6 M15 0.4 M19 1.5
M25 2.3 M41 0.9 M48 0.5 M79 1.1 M80 0.8 M81 1.4 N17 1.8 N18 1.4 N19 1.6 N20 0.7 N28 1.3 N39 3.2 R00 0.7 R02 1.0 R11 0.3
R13 0.8 R26 2.6 R29 3.6 R31 3.0 R32 1.2 R33 1.3 R40 2.5 R41 2.7 R44 1.6 R45 1.2 R47 1.0 R50 0.1 R54 2.2 R55 1.8 R56 2.6
R63 0.9 R69 1.3 R79 0.6 R94 1.4 S00 3.2 S01 1.1 S06 2.4 S09 1.2 S22 1.8 S32 1.4 S42 2.3 S51 0.5 S72 1.4 S80 2.0 T83 2.4
U80 0.8 W01 0.9 W06 1.1 W10 0.9 W18 2.1 W19 3.2 X59 1.5 Y84 0.7 Y95 1.2 Z22 1.7 Z50 2.1 Z60 1.8 Z73 0.6 Z74 1.1 Z75 2.0
Z87 1.5 Z91 0.5 Z93 1.0 Z99 0.8
"""

# ICD-10 chapters: number, range, title (fixed values).
CHAPTERS_TEXT = """
I A00-B99 Certain infectious and parasitic diseases
II C00-D48 Neoplasms
III D50-D89 Diseases of the blood and blood-forming organs and certain disorders involving the immune mechanism
IV E00-E90 Endocrine, nutritional and metabolic diseases
V F00-F99 Mental and behavioural disorders
VI G00-G99 Diseases of the nervous system
VII H00-H59 Diseases of the eye and adnexia
VIII H60-H95 Diseases of the ear and mastoid process
IX I00-I99 Diseases of the circulatory system
X J00-J99 Diseases of the respiratory system
XI K00-K93 Diseases of the digestive system
XII L00-L99 Diseases of the skin and subcutaneous tissue
XIII M00-M99 Diseases of the musculoskeletal system and connective tissue
XIV N00-N99 Diseases of the genitourinary system
XV O00-O99 Pregnancy, childbirth and the puerperium
XVI P00-P96 Certain conditions originating in the perinatal period
XVII Q00-Q99 Congenital malformations, deformations and chromosomal abnormalities
XVIII R00-R99 Symptoms, signs and abnormal clinical and laboratory findings, not elsewhere classified
XIX S00-T98 Injury, poisoning and certain other consequences of external causes
XX V01-Y98 External causes of morbidity and mortality
XXI Z00-Z99 Factors influencing health status and contact with health services
XXII U00-U99 Codes for special purposes
"""

# Names of intra-operative items (fixed values).
VITAL_NAMES_TEXT = """
air aft alb20 alb5 art_dbp art_mbp art_sbp bis bt cbro2 ci cpat cryo cvp d10w d50w d5w dobui dopai ds ebl eph epi epii
etco2 etdes etgas etiso etsevo ffp fio2 ftn hes hns hr hs mdz minvol mlni n2o nepi nibp_dbp nibp_mbp nibp_sbp ns ntgi o2
pap_dbp pap_mbp pap_sbp pc peep pepi phe pheresis pip pmean ppf ppfi pplat psa rbc rfti rr sft spo2 sti stii stiii stv5
svi uo vaso vt
"""

# Departments: abbreviation, name, and a star for those of interest (fixed values).
DEPARTMENTS_TEXT = """
AN Anesthesiology
CTS* Cardio-Thoracic Surgery
DM Dermatology
EM Emergency Medicine
GS* General Surgery
IM Internal Medicine
NS* Neurosurgery
OG* Obstetrics & Gynecology
OL* Oto-laryngology
OS* Orthopedic Surgery
OT* Ophthalmology
PED Pediatrics
PS* Plastic Surgery
RAD Radiology
RO Radiation Oncology
UR* Urology
"""

#: The laboratory items of the pre-operative feature table, in their order (fixed values).
PREOP_LABS = ("hb", "platelet", "aptt", "wbc", "ptinr", "glucose", "bun", "albumin", "ast", "alt", "creatinine", "sodium", "potassium")


#: Code prefixes of diagnoses that are left out of the data, and why (fixed values).
EXCLUDED_TEXT = """
A30 | Leprosy
A31 | Other mycobacteria infection
A5,A60,A61,A62,A63,A64 | Sexual transmitted diseases (A50~A64)
A81 | Prion disease
B20,B21,B22,B23,B24 | HIV infection (B20~B24)
B973 | Retrovirus as a cause of disease
B977 | Papilloma virus as a cause of disease
D12 | Benign neoplasm of colon rectum and anus
D55,D56,D57,D58,D59,D60,D61,D64 | Rare anaemias
D66,D67,D68,D69 | Coagulation factor deficiency
D70,D71,D72 | Congenital hematologic diseases
D75,D76,D77 | Other hereditary or rare hematologic diseases
D80,D81,D82,D83,D84,D86,D89 | Immunologic diseases
E16 | Other disorders of pancreatic internal secretion
E20,E22,E23,E24,E25,E26,E27,E34,E55 | Rare endocrine diseases
E7,E80,E83,E84,E85,E88 | Metabolic disorders except for volume depletion (E86) and acid-base imbalance (E87)
F | Mental disorder (F00~F99)
G04,G10,G11,G12,G23,G24,G25,G31,G35,G36,G40,G41,G47,G49,G51,G56,G57,G60,G61,G70,G71,G72,G73,G90,G93,G95 | Rare neurologic diseases
H16,H31,H35,H49,H51 | Rare eye diseases
I27,I42,I47,I49,I67,I73,I78,I79,I82,I88 | Rare cardiac diseases
J84,J39 | Rare airway or interstitial pulmonary diseases
K00,K50,K74,K75,K83 | Rare digestive diseases
L10,L12,L73 | Rare skin diseases
M06,M08,M30,M31,M32,M33,M34,M35,M61,M88,M89,M92,M93,M94 | Rare musculoskeletal diseases
N04,N25 | Nephrotic syndrome
O04,O07,O313,O35,O36,O98 | Abortion related
P | Conditions originating in the perinatal period (P00~P96)
Q | Congenital malformation (Q00~Q99)
R75 | Laboratory evidence of HIV
T74 | Adult and child abuse neglect and other maltreatment
Z114,Z206,Z21,Z332,Z717,Z78,Z830 | HIV related
"""


def hfrs_points() -> list[tuple[str, float]]:
    words = HFRS_TEXT.split()
    return [(c, float(p)) for c, p in zip(words[::2], words[1::2], strict=True)]


def chapters() -> list[tuple[int, str, str, str, str, str]]:
    """(place, number, block, first code, last code, title)."""
    rows = []
    for place, line in enumerate(CHAPTERS_TEXT.strip().splitlines()):
        number, block, title = line.split(" ", 2)
        rows.append((place, number, block, *block.split("-"), title))
    return rows


def vital_names() -> list[str]:
    return VITAL_NAMES_TEXT.split()


def departments() -> list[tuple[str, str, bool]]:
    rows = []
    for line in DEPARTMENTS_TEXT.strip().splitlines():
        code, name = line.split(" ", 1)
        rows.append((code.rstrip("*"), name, code.endswith("*")))
    return rows


def excluded() -> list[tuple[str, str]]:
    """(comma list of prefixes, cause)."""
    return [tuple(x.strip() for x in line.split("|")) for line in EXCLUDED_TEXT.strip().splitlines()]
