"""Role maps of event logs: which column is the case, the activity, the label, and so on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class LogSpec:
    name: str
    case: str = "Case ID"
    activity: str = "Activity"
    timestamp: str = "Complete Timestamp"
    resource: str | None = None
    label: str = "label"
    pos_label: str = "deviant"
    neg_label: str = "regular"
    dynamic_cat: tuple[str, ...] = ()
    static_cat: tuple[str, ...] = ()
    dynamic_num: tuple[str, ...] = ()
    static_num: tuple[str, ...] = ()
    # columns that make the order of equal timestamps total
    tie: tuple[str, ...] = ()
    filename: str | None = None

    @property
    def cat(self) -> tuple[str, ...]:
        return self.dynamic_cat + self.static_cat

    @property
    def num(self) -> tuple[str, ...]:
        return self.dynamic_num + self.static_num

    @property
    def time_order(self) -> tuple[str, ...]:
        """Order of cleaning and time features: by time, ties by the tie columns."""
        return _unique((self.timestamp, *self.tie))

    @property
    def event_order(self) -> tuple[str, ...]:
        """Order of splits, prefixes and encoders: by time, then activity, then the tie columns."""
        return _unique((self.timestamp, self.activity, *self.tie))

    @property
    def roles(self) -> tuple[str, ...]:
        return _unique((self.case, self.activity, self.timestamp, *self.cat, *self.num, *self.tie))

    def schema(self, timestamp_as_text: bool = True) -> T.StructType:
        """Declared types of a labelled log: text for categories, double for numbers."""
        text = _unique((self.case, self.activity, self.timestamp, self.label, *self.cat))
        fields = [T.StructField(c, T.StringType()) for c in text]
        if not timestamp_as_text:
            fields[text.index(self.timestamp)] = T.StructField(self.timestamp, T.TimestampNTZType())
        fields += [T.StructField(c, T.DoubleType()) for c in self.num]
        return T.StructType(fields)

    def with_(self, **changes) -> LogSpec:
        return replace(self, **changes)


def _unique(names) -> tuple[str, ...]:
    return tuple(dict.fromkeys(names))


# ---------------------------------------------------------------------------------------------
# Column roles of the supported public logs. They name the columns of the published
# CSV files and must stay as they are.

TIME_FEATURES = ("timesincelastevent", "timesincecasestart", "timesincemidnight", "event_nr", "month",
                 "weekday", "hour", "open_cases")
CALENDAR_FIRST = ("hour", "weekday", "month", "timesincemidnight", "timesincelastevent", "timesincecasestart")

TRAFFIC_FINES = LogSpec(
    name="traffic_fines", resource="Resource",
    dynamic_cat=("Activity", "Resource", "lastSent", "notificationType", "dismissal"),
    static_cat=("article", "vehicleClass"),
    dynamic_num=("expense", *TIME_FEATURES),
    static_num=("amount", "points"))

SEPSIS_CASES = LogSpec(
    name="sepsis_cases", resource="org:group", timestamp="time:timestamp",
    dynamic_cat=("Activity", "org:group"),
    static_cat=("Diagnose", "DiagnosticArtAstrup", "DiagnosticBlood", "DiagnosticECG", "DiagnosticIC",
                "DiagnosticLacticAcid", "DiagnosticLiquor", "DiagnosticOther", "DiagnosticSputum",
                "DiagnosticUrinaryCulture", "DiagnosticUrinarySediment", "DiagnosticXthorax", "DisfuncOrg",
                "Hypotensie", "Hypoxie", "InfectionSuspected", "Infusion", "Oligurie", "SIRSCritHeartRate",
                "SIRSCritLeucos", "SIRSCritTachypnea", "SIRSCritTemperature", "SIRSCriteria2OrMore"),
    dynamic_num=("CRP", "LacticAcid", "Leucocytes", *CALENDAR_FIRST),
    static_num=("Age",))

PRODUCTION = LogSpec(
    name="production", resource="Resource", filename="Production.csv",
    dynamic_cat=("Activity", "Resource", "Report_Type", "Resource.1"),
    static_cat=("Part_Desc_", "Rework"),
    dynamic_num=("Qty_Completed", "Qty_for_MRB", "activity_duration", *CALENDAR_FIRST, "event_nr", "open_cases"),
    static_num=("Work_Order_Qty",))

BPIC2017 = LogSpec(
    name="bpic2017", resource="org:resource", timestamp="time:timestamp",
    dynamic_cat=("Activity", "org:resource", "Action", "EventOrigin", "lifecycle:transition", "Accepted",
                 "Selected"),
    static_cat=("ApplicationType", "LoanGoal"),
    dynamic_num=("FirstWithdrawalAmount", "MonthlyCost", "NumberOfTerms", "OfferedAmount", "CreditScore",
                 *TIME_FEATURES),
    static_num=("RequestedAmount",))

HOSPITAL_BILLING = LogSpec(
    name="hospital_billing", resource="Resource",
    dynamic_cat=("Activity", "Resource", "actOrange", "actRed", "blocked", "caseType", "diagnosis", "flagC",
                 "flagD", "msgCode", "msgType", "state", "version"),
    static_cat=("speciality",),
    dynamic_num=("msgCount", *TIME_FEATURES))

BPIC2012 = LogSpec(
    name="bpic2012", resource="Resource",
    dynamic_cat=("Activity", "Resource"),
    dynamic_num=(*CALENDAR_FIRST, "event_nr", "open_cases"),
    static_num=("AMOUNT_REQ",))

BPIC2017_FILES = {"cancelled": "BPIC17_O_Cancelled.csv", "accepted": "BPIC17_O_Accepted.csv",
                  "refused": "BPIC17_O_Refused.csv"}
BPIC2012_FILES = {"cancelled": "bpic2012_O_CANCELLED-COMPLETE.csv", "accepted": "bpic2012_O_ACCEPTED-COMPLETE.csv",
                  "declined": "bpic2012_O_DECLINED-COMPLETE.csv"}

# Logs whose positive outcome is the regular one.
SWAPPED = ("sepsis_cases_4", "hospital_billing_1")

GROUP_ALIASES = {
    "sepsis_cases": ("sepsis_cases_1", "sepsis_cases_2", "sepsis_cases_4"),
}

# The names under which datasets are reported.
REPORT_NAMES = {"hospital_billing_3": "hospital_billing", "traffic_fines_1": "traffic_fines",
                "sepsis_cases_4": "sepsis_cases_3"}
# ---------------------------------------------------------------------------------------------


def _build_registry() -> dict[str, LogSpec]:
    registry: dict[str, LogSpec] = {}

    def add(base: LogSpec, name: str, filename: str) -> None:
        labels = {"pos_label": "regular", "neg_label": "deviant"} if _stem(name) in SWAPPED else {}
        registry[name] = base.with_(name=name, filename=filename, **labels)

    for formula in (1, 2):
        add(TRAFFIC_FINES, f"traffic_fines_{formula}", f"traffic_fines_{formula}.csv")
    for formula in range(1, 5):
        add(SEPSIS_CASES, f"sepsis_cases_{formula}", f"sepsis_cases_{formula}.csv")
    add(PRODUCTION, "production", "Production.csv")
    for outcome, filename in BPIC2017_FILES.items():
        add(BPIC2017, f"bpic2017_{outcome}", filename)
    for formula in range(1, 7):
        for sample in ("", "_sample10000", "_sample30000"):
            name = f"hospital_billing_{formula}{sample}"
            add(HOSPITAL_BILLING, name, f"{name}.csv")
    for outcome, filename in BPIC2012_FILES.items():
        add(BPIC2012, f"bpic2012_{outcome}", filename)
    return registry


def _stem(name: str) -> str:
    return name.split("_sample")[0]


_REGISTRY = _build_registry()


def spec(name: str) -> LogSpec:
    if name not in _REGISTRY:
        raise KeyError(f"unknown log {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def spec_names() -> list[str]:
    return list(_REGISTRY)


def expand(name: str) -> tuple[str, ...]:
    """A group alias gives its datasets, any other name itself."""
    return GROUP_ALIASES.get(name, (name,))
