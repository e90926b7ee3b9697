"""The API surface that traces are hooked on: what a trace can hold, so that what it never holds can be told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Hooked members by object, in the order in which they are hooked.
CANVAS_PROPERTIES = ["strokeStyle", "fillStyle", "shadowColor", "filter", "font"]
CANVAS_METHODS = [
    "fillRect", "rect", "arc", "getImageData", "strokeRect", "clearRect", "createRadialGradient", "bezierCurveTo", "fillText", "strokeText", "createPattern", "createLinearGradient", "putImageData",
    "setLineDash", "createImageData", "arcTo", "moveTo", "lineTo", "translate", "drawImage", "quadraticCurveTo", "save", "restore", "addEventListener", "measureText",
]
ELEMENT = ["getElementsByTagName", "toDataURL", "toBlob", "getContext", "addEventListener", "width", "height"]
AUDIO = ["createChannelMerger", "createBuffer", "createScriptProcessor"]
OFFLINE_AUDIO = ["destination", "oncomplete", "createScriptProcessor", "createOscillator", "createDynamicsCompressor", "startRendering"]
WEBGL = [
    "viewport", "scissor", "readPixels", "bufferData", "getAttribLocation", "getUniformLocation", "getShaderParameter", "getProgramParameter", "getActiveAttrib", "getActiveUniform", "bindAttribLocation",
    "uniform2f", "vertexAttribPointer", "drawArrays", "clearColor", "getShaderPrecisionFormat", "texParameteri", "pixelStorei", "drawElements", "blendFunc", "framebufferTexture2D", "texImage2D", "blendColor",
    "colorMask", "blendFuncSeparate", "framebufferRenderbuffer", "blendEquationSeparate", "hint", "stencilOp", "renderbufferStorage",
]
PEER = ["localDescription", "onicecandidate", "createDataChannel", "createOffer"]
HOOKED = {
    "canvasrenderingcontext2d": CANVAS_PROPERTIES + CANVAS_METHODS, "window.document": ["cookie"], "document": ["getElementsByTagName"], "htmlcanvaselement": ELEMENT, "audiocontext": AUDIO,
    "offlineaudiocontext": OFFLINE_AUDIO, "webglrenderingcontext": WEBGL, "webgl2renderingcontext": WEBGL, "rtcpeerconnection": PEER,
}


def symbols() -> list[str]:
    """The symbols that traces have, lower-cased."""
    return [f"{owner}.{member.lower()}" for owner, members in HOOKED.items() for member in members]


def surface(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in symbols()], "symbol string")
