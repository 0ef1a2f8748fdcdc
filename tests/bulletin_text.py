"""Hand-written bulletins."""


def kind(kind_name: str, inner: str) -> str:
    return f"<Kind><Property><Type>{kind_name}</Type>{inner}</Property></Kind>"


def name(text: str = "SHANSHAN") -> str:
    return kind("呼称", f"<TyphoonNamePart><Name>{text}</Name></TyphoonNamePart>")


def centre(position: str = "+2230+13450/", rest: str = "", location: str = "Sea") -> str:
    return kind(
        "中心",
        f"<CenterPart><jmx_eb:Coordinate type='a'>x</jmx_eb:Coordinate>"
        f"<jmx_eb:Coordinate type='b'>{position}</jmx_eb:Coordinate>"
        f"<Location>{location}</Location>{rest}</CenterPart>",
    )


def speeds(*values: str) -> str:
    return "".join(f"<jmx_eb:WindSpeed unit='k'>{v}</jmx_eb:WindSpeed>" for v in values)


def axis(direction: str, radii: tuple[str, ...]) -> str:
    return (
        f"<jmx_eb:Axis>{direction}"
        + "".join(f"<jmx_eb:Radius unit='u'>{r}</jmx_eb:Radius>" for r in radii)
        + "</jmx_eb:Axis>"
    )


def direction(text: str = "", unit: str | None = "８方位漢字", **attributes: str) -> str:
    given = {"unit": unit, **attributes} if unit else attributes
    listed = "".join(f" {k}='{v}'" for k, v in given.items())
    return f"<jmx_eb:Direction{listed}>{text}</jmx_eb:Direction>"


def area(area_type: str, *axes: str) -> str:
    return (
        f"<WarningAreaPart type='{area_type}'><jmx_eb:Circle><jmx_eb:Axes>"
        + "".join(axes)
        + "</jmx_eb:Axes></jmx_eb:Circle></WarningAreaPart>"
    )


def wind(values: tuple[str, ...] = ("1", "2", "3", "4"), areas: str = "") -> str:
    return kind("風", f"<WindPart>{speeds(*values)}</WindPart>{areas}")


def section(time: str, *items: str, kind_of_time: str = "実況") -> str:
    body = "".join(f"<Item>{i}</Item>" for i in items)
    return (
        f"<MeteorologicalInfo><DateTime type='{kind_of_time}'>{time}</DateTime>"
        f"{body}</MeteorologicalInfo>"
    )


def bulletin(
    *sections: str, event: str = "TC01", serial: str = "1", info: str = "発表"
) -> str:
    return (
        f"<Report><Head><EventID>{event}</EventID><InfoType>{info}</InfoType>"
        f"<Serial>{serial}</Serial><InfoKindVersion>1.0_0</InfoKindVersion></Head>"
        f"<Body><MeteorologicalInfos>{''.join(sections)}</MeteorologicalInfos></Body></Report>"
    )
