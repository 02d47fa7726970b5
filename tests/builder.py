"""Coverage documents for tests."""


def line(number, hits=None, cond=None, conds=(), branch="true"):
    attrs = f'number="{number}"' + (f' hits="{hits}"' if hits is not None else "")
    if cond is not None:
        attrs += f' branch="{branch}" condition-coverage="{cond}"'
    inner = "".join(f'<condition number="{n}" type="jump" coverage="{c}"/>' for n, c in conds)
    return f"<line {attrs}>" + (f"<conditions>{inner}</conditions>" if inner else "") + "</line>"


def method(name, lines=(), signature="()", complexity=None):
    attr = f' complexity="{complexity}"' if complexity is not None else ""
    return f'<method name="{name}" signature="{signature}"{attr}><lines>{"".join(lines)}</lines></method>'


def cls(filename, lines=(), methods=(), name="C"):
    file = f' filename="{filename}"' if filename is not None else ""
    return f'<class name="{name}"{file}><methods>{"".join(methods)}</methods><lines>{"".join(lines)}</lines></class>'


def document(*classes, roots=(), head='<?xml version="1.0"?>'):
    sources = "".join(f"<source>{r}</source>" for r in roots)
    return f'{head}<coverage line-rate="0.1"><sources>{sources}</sources><packages><package name="p"><classes>{"".join(classes)}</classes></package></packages></coverage>'


def metrics(namespace, types):
    """types: {name: [(element, display, complexity or None, accessors)]}"""

    def metric(n):
        return "" if n is None else f'<Metrics><Metric Name="MaintainabilityIndex" Value="9"/><Metric Name="CyclomaticComplexity" Value="{n}"/></Metrics>'

    def member(element, display, n, accessors=()):
        inner = "".join(f'<Method Name="{d}">{metric(c)}</Method>' for d, c in accessors)
        inner = f"<Accessors>{inner}</Accessors>" if inner else ""
        return f'<{element} Name="{display}">{metric(n)}{inner}</{element}>'

    body = "".join(f'<NamedType Name="{t}"><Metrics><Metric Name="CyclomaticComplexity" Value="99"/></Metrics><Members>{"".join(member(*m) for m in ms)}</Members></NamedType>' for t, ms in types.items())
    return f'<CodeMetricsReport><Targets><Target Name="x"><Assembly Name="a"><Namespaces><Namespace Name="{namespace}"><Types>{body}</Types></Namespace></Namespaces></Assembly></Target></Targets></CodeMetricsReport>'
