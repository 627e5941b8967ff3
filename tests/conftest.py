import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskspark.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=8)
    yield s
    s.stop()


STUDENT_COLS = ("student_id string, name string, gender string, age int, department string, "
                "attendance_percentage double, assignment_score double, quiz_score double, lab_score double, "
                "midterm_marks double, lms_activity double, videos_watched int, discussion_participation int, "
                "result string")


def student_row(sid, att=80.0, asn=70.0, quiz=60.0, lab=65.0, mid=55.0, lms=60.0, vid=20, disc=10,
                result="Pass", gender="Male", age=20, dept="CS", name=None):
    return (sid, name or f"Name {sid}", gender, age, dept, att, asn, quiz, lab, mid, lms, vid, disc, result)


# the reference tests' two literal records
WEAK = dict(att=55.0, asn=42.0, quiz=38.0, lab=48.0, mid=35.0, lms=25.0, vid=4, disc=2)
STRONG = dict(att=95.0, asn=90.0, quiz=88.0, lab=92.0, mid=85.0, lms=90.0, vid=45, disc=30)
