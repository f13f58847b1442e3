"""Values that fix the semantics of the measures."""

import math

PHI = (1 + math.sqrt(5)) / 2
PHI_INV = 1 / PHI
TAU = 3 / math.sqrt(7)
ETA = 1 - PHI_INV

# fixed values
FIBONACCI = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377]
HARMONIOUS, AWAKENING = 85.0, 60.0
SCORE_FLOOR = 40.0
STATUS = ["HERMÉTIQUE ✦", "EN ÉVEIL ◈", "DORMANT ░"]
RESERVE = ["ANTIFRAGILE ✦", "RÉSISTANT ◈", "FRAGILE ░"]
RISK_LEVELS = ["FAIBLE", "MOYEN", "ELEVE", "CRITIQUE"]
HYPOTHESES = ["H_MONOLITHE", "H_CHAOS_IMBRIQUE", "H_LEAK_RESSOURCE", "H_COUPLED_ARITE", "H_HARMONIQUE"]
PRIORS = [0.20, 0.25, 0.15, 0.15, 0.25]
MECHANISMS = ["construction", "effondrement", "barattage", "ajustement", "stable"]
SALIENCE = {"enonce_change": 10, "effondrement_preuve": 9, "nouvel_axiome": 9, "doublon": 8, "nouveau_sorry": 8, "symbole_perdu": 5, "corps_change": 1, "symbole_gagne": 1}
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
