"""Fixed values of the bulletin format, the document text and the prompts.

These are data, not logic: results are only right when they are spelled exactly
like this.
"""

# --- fixed values: bulletin vocabulary -------------------------------------
OBSERVED = "実況"
PROPERTY_NAME = "呼称"
PROPERTY_CENTRE = "中心"
PROPERTY_WIND = "風"
AREA_STORM = "暴風域"
AREA_GALE = "強風域"
AXIS_UNIT = "８方位漢字"
AXIS_BEARING = "方向"
AXIS_ALL_ROUND = "全域"
FEED_TITLE = "台風解析・予報情報（５日予報）"

# --- fixed values: observation fields and their types ----------------------
OBSERVATION_TYPES = {
    "EventID": "string",
    "ObservationTime": "string",
    "InfoType": "string",
    "Serial": "int",
    "InfoKindVersion": "string",
    "TyphoonName": "string",
    "CenterLat": "double",
    "CenterLon": "double",
    "CenterLocation": "string",
    "CenterMovementDirection": "string",
    "CenterSpeed": "double",
    "CentralPressure": "double",
    "MaxWindspeedNearCenter": "double",
    "MaxGustSpeed": "double",
    "Bofuuiki_Direction1": "string",
    "Bofuuiki_Radius1": "double",
    "Bofuuiki_Direction2": "string",
    "Bofuuiki_Radius2": "double",
    "Kyofuuiki_Direction1": "string",
    "Kyofuuiki_Radius1": "double",
    "Kyofuuiki_Direction2": "string",
    "Kyofuuiki_Radius2": "double",
    "URL": "string",
}

# --- fixed values: text of one document, one line per entry ----------------
DOCUMENT_LINES = (
    "Event ID: {EventID}",
    "Observation Time: {ObservationTime}",
    "Info Type: {InfoType}",
    "Serial: {Serial}",
    "Info Kind Version: {InfoKindVersion}",
    "Typhoon Name: {TyphoonName}",
    "Center Latitude: {CenterLat}",
    "Center Longitude: {CenterLon}",
    "Center Location: {CenterLocation}",
    "Center Movement Direction: {CenterMovementDirection}",
    "Center Speed: {CenterSpeed} km/h",
    "Central Pressure: {CentralPressure} hPa",
    "Max Windspeed Near Center: {MaxWindspeedNearCenter} km/h",
    "Max Gust Speed: {MaxGustSpeed} km/h",
    "Bofuuiki Direction 1: {Bofuuiki_Direction1}, Radius 1: {Bofuuiki_Radius1}",
    "Bofuuiki Direction 2: {Bofuuiki_Direction2}, Radius 2: {Bofuuiki_Radius2}",
    "Kyofuuiki Direction 1: {Kyofuuiki_Direction1}, Radius 1: {Kyofuuiki_Radius1}",
    "Kyofuuiki Direction 2: {Kyofuuiki_Direction2}, Radius 2: {Kyofuuiki_Radius2}",
)
# how a missing value is spelled in that text
MISSING = "nan"
MISSING_BY_FIELD = {"TyphoonName": "Unknown", "CenterSpeed": "N/A"}
BAD_TIME = "Unknown"

# --- fixed values: parsed-question format ----------------------------------
# "<name>, (None|date|datetime)?[, (''|None|date|datetime)]"; (?U) lets \w and
# \d cover all of Unicode.
QUESTION_GATE = r"(?U)^(?:None|[\w\s]+), (?:None|\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?)?(?:, (?:''|None|\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?))?$"

# --- fixed values: answer prompt -------------------------------------------
ANSWER_PROMPT = """
        You are a helpful AI bot with expertise in typhoon data.
        If you are asked about matters out of this scope, kindly reply your inability to answer.
        Based on the context {context}, answer the {query}.
        Provide factual and concise answer.
        When asked about trajectory, use the context and conclude the movement from the beginning of the period to the end of the period.
        When asked about position at specific date and time, answer with the precise Latitude, Longitude and location narrative.
    """
