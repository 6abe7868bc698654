"""Business parameters of the survey dashboards.

Every composed query takes a ``SurveyParams``; the defaults below reproduce the
dashboard.  Callers override per query with ``dataclasses.replace``.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# These must equal the dashboard's business constants, otherwise
# results differ.  Natural order, as the dashboard states them.
# ---------------------------------------------------------------------------
SURVEY_IDS = (18, 30, 31)            # surveys on the live pages
JOINED_SURVEY_IDS = (18, 30)         # surveys of the joined "realtime" variants
HOUSEHOLD_QIDS = (614, 615, 616)     # household ("vivienda") questions
SECTOR_QIDS = (477, 863)             # sector questions
COORD_QID = 55                       # coordinates question used by the map SQL
PERSONS_QID = 100                    # persons question (number or {"cantidad": n})
PERSONS_TEXT_QID = 600               # persons question (free text, digits kept)
DEFAULT_CENTRE = (4.65, -74.1)       # map centre when there is no point
DEFAULT_ZOOM = 8                     # zoom when there is no point
ZOOM_STEPS = ((0.5, 8), (0.1, 11), (0.05, 13))  # (max distance above, zoom)
CLOSE_ZOOM = 14                      # zoom when every point is within 0.05
HOUSEHOLD_PAYLOAD_QID = 122          # question id that the households answer states
NO_SECTOR = "SIN SECTOR"             # label of a missing sector and of the total
HOUSEHOLD_RADIUS = 5                 # marker radius of the household layer
HEAT_RADIUS = 12                     # pixels of a heat point, and of its blurred edge
HEAT_BLUR = 8
PERSON_BASE_RADIUS = 3               # person layer radius = 3 + persons
ZONE = "America/Bogota"               # the project's clock: "today" is its date
PREVIEW_SIZE = 50                     # rows of the consolidated page's preview
MIN_POLYGON_POINTS = 3               # a sector is drawn as a polygon from 3 points


@dataclass(frozen=True)
class SurveyParams:
    survey_ids: tuple[int, ...] = SURVEY_IDS
    joined_survey_ids: tuple[int, ...] = JOINED_SURVEY_IDS
    household_qids: tuple[int, ...] = HOUSEHOLD_QIDS
    sector_qids: tuple[int, ...] = SECTOR_QIDS
    coord_qid: int = COORD_QID
    persons_qid: int = PERSONS_QID
    persons_text_qid: int = PERSONS_TEXT_QID
    default_centre: tuple[float, float] = DEFAULT_CENTRE
    default_zoom: int = DEFAULT_ZOOM
    no_sector: str = NO_SECTOR
    # "fail": a bad number fails the query (ANSI cast); "null": it becomes NULL.
    on_bad: str = "fail"
    # density grid: cells per degree (100 -> 0.01 degree cells); an integer so
    # the cell index is exact decimal arithmetic.
    cells_per_degree: int = 100
    zone: str = ZONE
    preview_size: int = PREVIEW_SIZE
    # entries of a list inside a payload text, which tells if there are more;
    # the list frames and the pages hold all of them
    payload_list: int = 10_000
    # zooms of the heat layer: those that the page opens with
    heat_zooms: tuple[int, ...] = (DEFAULT_ZOOM, 11, 13, CLOSE_ZOOM)
    heat_radius: int = HEAT_RADIUS
    heat_blur: int = HEAT_BLUR
    # entries of a page of a list
    page_size: int = 20

    def __post_init__(self):
        if self.on_bad not in ("fail", "null"):
            raise ValueError(f"on_bad must be 'fail' or 'null', got {self.on_bad!r}")
        if self.cells_per_degree <= 0:
            raise ValueError("cells_per_degree must be positive")


DEFAULTS = SurveyParams()
