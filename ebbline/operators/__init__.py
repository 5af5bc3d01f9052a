"""Batch operators: functions from DataFrame to DataFrame, for ``df.transform``."""

from ebbline.operators.clean import *  # noqa: F403
from ebbline.operators.enrich import *  # noqa: F403
from ebbline.operators.features import *  # noqa: F403
from ebbline.operators.sessions import *  # noqa: F403
