from tidewell.plans import streams
from tidewell.streaming import stateful


def test_folded_conversations_hold_whole_texts(spark):
    texts = ['Dice "sí" y \\ luego\notra línea, que es más larga que veinte letras.', "Una respuesta que también pasa de veinte letras con mucho.", ""]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    found = stateful.folded_batch(streams.messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert found.texts == f"paciente: {texts[0]} | agente: {texts[1]} | paciente: {texts[2]}"
