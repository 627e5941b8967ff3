"""Parameters of every operator, with the reference application's values as defaults.

Everything below the "fixed values" marker must equal the reference application's
values for results to match (column contract, valid ranges, weights, thresholds,
labels and recommendation texts). It is stated plainly, in the order the
reference uses, and is the only place these values live.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# fixed values (must equal the reference application's)
# ---------------------------------------------------------------------------

ID_COLUMN = "student_id"
NAME_COLUMN = "name"
TARGET_COLUMN = "result"

REQUIRED_COLUMNS = [
    "student_id", "name", "gender", "age", "department",
    "attendance_percentage", "assignment_score", "quiz_score",
    "lab_score", "midterm_marks", "lms_activity",
    "videos_watched", "discussion_participation",
]

CATEGORICAL_FEATURES = ["gender", "department"]

NUMERIC_FEATURES = [
    "age", "attendance_percentage",
    "assignment_score", "quiz_score", "lab_score",
    "midterm_marks", "lms_activity", "videos_watched",
    "discussion_participation",
]

ENGINEERED_FEATURES = [
    "attendance_risk", "assignment_completion_ratio",
    "engagement_score", "performance_trend", "overall_academic_score",
]

MODEL_FEATURES = NUMERIC_FEATURES + ENGINEERED_FEATURES

# Valid range of each numeric column (clip bounds).
NUMERIC_RANGES = {
    "age": (15, 35),
    "attendance_percentage": (0, 100),
    "assignment_score": (0, 100),
    "quiz_score": (0, 100),
    "lab_score": (0, 100),
    "midterm_marks": (0, 100),
    "lms_activity": (0, 100),
    "videos_watched": (0, 200),
    "discussion_participation": (0, 100),
}

# Attendance bands for attendance_risk.
ATTENDANCE_HIGH = 85
ATTENDANCE_MEDIUM = 75

# Weights of overall_academic_score, in this order.
SCORE_WEIGHTS = {
    "attendance_percentage": 0.20,
    "assignment_score": 0.20,
    "midterm_marks": 0.30,
    "quiz_score": 0.15,
    "lab_score": 0.15,
}

# Engagement score: lms 40 %, videos (cap 60) 30 %, discussion (cap 50) 30 %.
ENGAGEMENT_WEIGHTS = {"lms_activity": 0.40, "videos_watched": 0.30, "discussion_participation": 0.30}
VIDEOS_CAP = 60
DISCUSSION_CAP = 50

# Risk bands on the fail probability.
RISK_HIGH = 0.70
RISK_MEDIUM = 0.40
RISK_LABEL_HIGH = "High Risk"
RISK_LABEL_MEDIUM = "Medium Risk"
RISK_LABEL_LOW = "Low Risk"

# Gauge steps of the risk score (0-100).
GAUGE_STEPS = [(0, 40), (40, 70), (70, 100)]

# Single-record imputation constants.
SINGLE_NUMERIC_FILL = 0.0
SINGLE_CATEGORICAL_FILL = "Unknown"
UNKNOWN_ID = "UNKNOWN"
UNKNOWN_NAME = "Unknown"

# Model settings.
TEST_SIZE = 0.2
RANDOM_STATE = 42
CV_FOLDS = 5
PARALLEL_FITS = 6   # (model, fold) fits that run at a time
RF_PARAMS = {"n_estimators": 200, "max_depth": 10, "min_samples_split": 5}
LR_PARAMS = {"max_iter": 1000, "C": 1.0}
GBT_PARAMS = {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.1}
MODEL_ORDER = ["Logistic Regression", "Random Forest", "Gradient Boosting"]

# Recommendation thresholds.
REC_THRESHOLDS = {
    "attendance_low": 75,
    "attendance_critical": 60,
    "assignment_low": 50,
    "quiz_low": 45,
    "lab_low": 50,
    "midterm_low": 40,
    "lms_low": 30,
    "videos_low": 10,
    "discussion_low": 5,
}

PRIORITY_RANK = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4}

# Value assumed when a column is absent from the frame (not when a value is NULL).
REC_ABSENT_DEFAULTS = {
    "attendance_percentage": 100.0,
    "assignment_score": 100.0,
    "quiz_score": 100.0,
    "lab_score": 100.0,
    "midterm_marks": 100.0,
    "lms_activity": 100.0,
    "videos_watched": 20.0,
    "discussion_participation": 10.0,
}

# Recommendation rules, in evaluation order. ``{v}`` is the value as "%.1f",
# ``{n}`` the value truncated to an integer.
# (rule, column, threshold key, category, priority, icon, message, action)
RECOMMENDATION_RULES = [
    ("attendance_critical", "attendance_percentage", "attendance_critical",
     "Attendance", "CRITICAL", "🚨",
     "Your attendance is critically low ({v}%). You are at serious risk of being barred from exams. "
     "Attend every class without exception.",
     "Attend all remaining classes immediately."),
    ("attendance_low", "attendance_percentage", "attendance_low",
     "Attendance", "HIGH", "⚠️",
     "Attendance is below the required 75% threshold ({v}%). "
     "Missing further classes may lead to grade penalties.",
     "Aim for 100% attendance in remaining weeks."),
    ("assignment_low", "assignment_score", "assignment_low",
     "Assignments", "HIGH", "📝",
     "Assignment score ({v}/100) is low. "
     "Incomplete assignments significantly lower your overall grade.",
     "Complete all pending assignments and seek faculty feedback."),
    ("quiz_low", "quiz_score", "quiz_low",
     "Quiz Performance", "MEDIUM", "🧩",
     "Quiz score ({v}/100) indicates gaps in understanding. "
     "Regular self-testing can improve retention.",
     "Practice past quizzes and solve textbook exercises daily."),
    ("lab_low", "lab_score", "lab_low",
     "Lab / Practicals", "MEDIUM", "🔬",
     "Lab score ({v}/100) is weak. "
     "Practical skills are weighted heavily in AI/DS programs.",
     "Spend extra hours in the lab and complete all practicals."),
    ("midterm_low", "midterm_marks", "midterm_low",
     "Midterm Exam", "HIGH", "📊",
     "Midterm marks ({v}/100) are below the pass threshold. "
     "This strongly predicts difficulty in finals.",
     "Attend remedial classes and form study groups for revision."),
    ("lms_low", "lms_activity", "lms_low",
     "LMS Engagement", "MEDIUM", "💻",
     "LMS activity score ({v}/100) is very low. "
     "Online resources and assignments may have been missed.",
     "Log in to the LMS daily and complete all digital tasks."),
    ("videos_low", "videos_watched", "videos_low",
     "Video Learning", "LOW", "🎥",
     "Only {n} lecture videos watched. "
     "Video content reinforces classroom learning.",
     "Watch at least 2 lecture videos per day to catch up."),
    ("discussion_low", "discussion_participation", "discussion_low",
     "Peer Discussion", "LOW", "💬",
     "Discussion participation is very low ({n} interactions). "
     "Collaborative learning improves problem-solving skills.",
     "Participate in at least one forum thread per week."),
]

# Risk-level recommendation: exactly one fires (High, Medium, anything else).
RISK_RECOMMENDATIONS = [
    ("High Risk", "Remedial Support", "CRITICAL", "🏫",
     "You are classified as HIGH RISK. Immediate intervention is recommended.",
     "Meet with your faculty advisor and register for remedial classes this week."),
    ("Medium Risk", "Academic Support", "HIGH", "📚",
     "You are at MEDIUM RISK. Consistent effort now can prevent failure.",
     "Create a structured study plan and track weekly progress."),
    (None, "Maintain Performance", "LOW", "⭐",
     "Great work — you are LOW RISK! Keep up the momentum.",
     "Continue current habits and help peers who are struggling."),
]

# Radar profile axes and target line.
PROFILE_AXES = [
    ("Attendance", "attendance_percentage"),
    ("Assignment", "assignment_score"),
    ("Quiz", "quiz_score"),
    ("Lab", "lab_score"),
    ("Midterm", "midterm_marks"),
    ("LMS Activity", "lms_activity"),
    ("Engagement", "videos_watched"),
]
PROFILE_TARGET = 75

# Alert defaults.
ALERT_TYPE = "HIGH_RISK_EMAIL"
ALERT_STATUSES = ["sent", "failed", "pending"]
ALERT_SUBJECT_PREFIX = "🚨 HIGH RISK ALERT — "

# Labels that the tables' ENUM columns accept.
RESULT_DOMAIN = ["Pass", "Fail"]

# Dashboard settings.
HISTOGRAM_BINS = 20
HISTOGRAM_THRESHOLD = 75
PREVIEW_ROWS = 20
RECENT_PREDICTIONS = 500
TOP_IMPORTANCES = 15
WATERFALL_MAX_DISPLAY = 15
SAMPLE_ROWS = 20


@dataclass(frozen=True)
class CleanParams:
    """Column contract and ranges used by the cleaning operators."""

    required: list = field(default_factory=lambda: list(REQUIRED_COLUMNS))
    numeric: list = field(default_factory=lambda: list(NUMERIC_FEATURES))
    categorical: list = field(default_factory=lambda: list(CATEGORICAL_FEATURES))
    ranges: dict = field(default_factory=lambda: dict(NUMERIC_RANGES))
    id_col: str = ID_COLUMN
    target: str = TARGET_COLUMN


@dataclass(frozen=True)
class RiskParams:
    high: float = RISK_HIGH
    medium: float = RISK_MEDIUM
    label_high: str = RISK_LABEL_HIGH
    label_medium: str = RISK_LABEL_MEDIUM
    label_low: str = RISK_LABEL_LOW
