"""Rule catalogues.  Each family is data; :mod:`siftlake.operators.scan` runs it."""

from siftlake.rules.agents import AI_SDK
from siftlake.rules.api import API
from siftlake.rules.flow import SINKS, SOURCES
from siftlake.rules.infrastructure import IAC
from siftlake.rules.mining import CRYPTOJACK
from siftlake.rules.model import Family, Rule
from siftlake.rules.models import MODEL_LOAD
from siftlake.rules.prompts import AI_CONFIG, JAILBREAK
from siftlake.rules.sast import CLASSIC, COMMAND_LINE, HYBRID
from siftlake.rules.scripts import INSTALL_SCRIPT, INTENT, PERMISSION
from siftlake.rules.secrets import SECRETS

FAMILIES: dict[str, Family] = {
    f.name: f
    for f in (
        SECRETS, HYBRID, CLASSIC, COMMAND_LINE, JAILBREAK, CRYPTOJACK, IAC, API, MODEL_LOAD,
        INSTALL_SCRIPT, PERMISSION, AI_CONFIG, INTENT, AI_SDK, SOURCES, SINKS,
    )
}

__all__ = ["FAMILIES", "Family", "Rule"]
