"""Parameters of the registered evaluations (fixed values)."""

BLOCK = 256                       # block size T
LAB_TARGETS = ("lab.view", "lab.click")
CULTURE_TARGET = "culture.error"
RESULT_TOKENS = ("Growth", "No Growth")
MAGNITUDES = tuple(f"magnitude.{i}" for i in range(10))
LOW, HIGH = "magnitude.0", "magnitude.9"
DRUG = "med.purchase"
N_HOURS = 240                     # first-N-hours cut
LOS_MIN_DAYS = 29.0               # length-of-stay cohort threshold
HORIZON_HOURS = 12                # hand-off horizon
HORIZON_STEPS = 16                # steps of the expected-value rollout (a parameter of horizon_score)
HORIZON_TOKEN = "med.purchase"    # token whose horizon probability is the score
SHIFT_LIMIT = 1000                # rows of the limited shift cohort (its feature)
PANEL = ("lab.click", "lab.view")  # labs probed after an injected dose
FORWARD_PANEL = ("lab.click", "lab.view", "lab.view", "lab.click", "lab.click", "lab.view", "lab.click", "lab.view")  # in turn
HALF_LIFE = 64.0                  # tokens after which a token of the history weighs half
MEMORY_WEIGHT = 0.2               # share of the history in the log-linear score
TRACKED_LAB = "lab.view"          # the lab whose pre/post magnitude is compared
INJECTED = ("med.purchase", "unit.3", "magnitude.9")
HEAD = 12                         # strip padding, take the head
BATCH = 64                        # loss batches
TRAIN_FRACTION = 0.9
