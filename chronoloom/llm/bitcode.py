"""The passes of ctx_mix_lm over whole texts, within the executors' JVM.

Counting, learning and scoring look at each bit of each text in six or seven tables. As array code in Python workers that is some
ten passes over memory for each of them. Here it's a class over partitions that Spark's own compiler (Janino) makes on the driver;
its jar goes to the executors, whose JIT makes machine code of it. ctx_mix_lm has the same steps for arrays, with which the
weights begin, and the tests hold both against each other.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: No generics or lambdas: Janino leaves those out.
SOURCE = r"""
package chronoloom;

import java.io.File;
import java.io.RandomAccessFile;
import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.nio.IntBuffer;
import java.nio.MappedByteBuffer;
import java.nio.ShortBuffer;
import java.nio.channels.FileChannel;
import java.util.ArrayList;
import java.util.HashMap;
import java.util.Iterator;
import org.apache.spark.SparkEnv;
import org.apache.spark.SparkFiles;
import org.apache.spark.TaskContext;
import org.apache.spark.api.java.function.MapPartitionsFunction;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.sql.catalyst.expressions.XXH64;
import org.apache.spark.unsafe.Platform;

public class BitCode implements MapPartitionsFunction, java.io.Serializable {
    static final int COUNT = 0, LEARN = 1, SCORE = 2, BLOCK = 4096, GATES = 64, SPELLED = 0, END = 1, MID = 2, PART = 28, SLOTS = 4096;
    static final long LESS = (1L << PART) - 1;

    public HashMap given = new HashMap();
    public int pass;

    public void choose(int n) { pass = n; }

    public void put(String name, byte[] array) { given.put(name, array); }

    public void put(String name, String text) { given.put(name, text); }

    public void put(String name, double number) { given.put(name, Double.valueOf(number)); }

    ByteBuffer bytes(String name) { return ByteBuffer.wrap((byte[]) given.get(name)).order(ByteOrder.LITTLE_ENDIAN); }

    int[] ints(String name) {
        IntBuffer b = bytes(name).asIntBuffer();
        int[] out = new int[b.remaining()];
        b.get(out);
        return out;
    }

    float[] floats(String name) {
        java.nio.FloatBuffer b = bytes(name).asFloatBuffer();
        float[] out = new float[b.remaining()];
        b.get(out);
        return out;
    }

    double[] doubles(String name) {
        java.nio.DoubleBuffer b = bytes(name).asDoubleBuffer();
        double[] out = new double[b.remaining()];
        b.get(out);
        return out;
    }

    double number(String name) { return ((Double) given.get(name)).doubleValue(); }

    static byte[] packed(double[] x) {
        ByteBuffer b = ByteBuffer.allocate(8 * x.length).order(ByteOrder.LITTLE_ENDIAN);
        for (int i = 0; i < x.length; i++) b.putDouble(x[i]);
        return b.array();
    }

    static long hash(long h, long x) {
        h = (h ^ x) * 0xD6E8FEB86659FD93L;
        return h ^ (h >>> 32);
    }

    /** 1 / (1 + e^-z) at steps of 1 / FINE from -12 to 12, and how much more it is a step on; between steps a line is 2e-7 off at most. */
    static final int FINE = 256, STEPS = 24 * FINE + 1;
    static final float[] CURVE = new float[STEPS], RISE = new float[STEPS];

    static {
        for (int i = 0; i < STEPS; i++) {
            double z = (double) i / FINE - 12, more = (i + 1.0) / FINE - 12;
            CURVE[i] = (float) (1 / (1 + Math.exp(-z)));
            RISE[i] = (float) (1 / (1 + Math.exp(-more)) - 1 / (1 + Math.exp(-z)));
        }
    }

    /** The bits of a run of symbols with their contexts, and what the pass does with them. Large tables are mapped, in parts of 2^28 entries. */
    static class Model {
        int number, pass, contexts, bins, step, done, n, symbols, heads, levels;
        int[] start, nodes, sizes;
        byte[] length, places, bits, seen;
        long[] base;
        IntBuffer[] counts;
        ShortBuffer[] codes;
        float[] stretched, refine, refined;
        byte[] binOf;
        float[][] used;
        double rate, pushed;
        double[][] weights, moved;
        double[] gates = new double[GATES], hits, ones, out = new double[16];
        int[] saw = new int[GATES];
        long[] now, found;
        long[][] context;
        int[] owner = new int[BLOCK], of = new int[BLOCK], gate = new int[BLOCK], line = new int[BLOCK], node = new int[BLOCK], head = new int[BLOCK];
        long[] first = new long[BLOCK];
        byte[] bit = new byte[BLOCK], place = new byte[BLOCK];
        int[] code = new int[BLOCK];
        float[] z = new float[BLOCK];
        float[][] x;

        Model(BitCode t, int number, String name) throws Exception {
            this.number = number;
            pass = t.pass;
            start = t.ints(name + "start");
            nodes = t.ints(name + "nodes");
            sizes = t.ints(name + "sizes");
            length = (byte[]) t.given.get(name + "length");
            bits = (byte[]) t.given.get(name + "bits");
            places = (byte[]) t.given.get(name + "places");
            levels = (int) t.number(name + "levels");
            contexts = sizes.length;
            base = new long[contexts + 1];
            for (int k = 0; k < contexts; k++) base[k + 1] = base[k] + (1L << sizes[k]);
            now = new long[contexts];
            context = new long[contexts][BLOCK];
            if (pass == COUNT) {
                long cells = 2 * base[contexts];
                counts = new IntBuffer[(int) ((cells + LESS) >>> PART)];
                File f = File.createTempFile("chronoloom-", ".counts", new File(org.apache.spark.util.Utils.getLocalDir(SparkEnv.get().conf())));
                RandomAccessFile file = new RandomAccessFile(f, "rw");
                try {
                    file.setLength(4 * cells);
                    for (int k = 0; k < counts.length; k++) counts[k] = part(file, FileChannel.MapMode.READ_WRITE, k, 4, cells).asIntBuffer();
                } finally {
                    file.close();
                    f.delete();
                }
                return;
            }
            long slots = base[contexts];
            codes = new ShortBuffer[(int) ((slots + LESS) >>> PART)];
            RandomAccessFile file = new RandomAccessFile(SparkFiles.get((String) t.given.get(name + "file")), "r");
            try {
                for (int k = 0; k < codes.length; k++) codes[k] = part(file, FileChannel.MapMode.READ_ONLY, k, 2, slots).asShortBuffer();
            } finally {
                file.close();
            }
            stretched = t.floats("stretched");
            seen = (byte[]) t.given.get("seen");
            refine = t.floats(name + "refine");
            bins = refine.length / 4;
            double[] w = t.doubles(name + "weights");
            weights = new double[contexts][GATES];
            used = new float[contexts][GATES];
            moved = new double[contexts][GATES];
            for (int k = 0; k < contexts; k++) {
                for (int g = 0; g < GATES; g++) {
                    weights[k][g] = w[k * GATES + g];
                    used[k][g] = (float) weights[k][g];
                }
            }
            hits = new double[refine.length];
            ones = new double[refine.length];
            found = new long[refine.length];
            binOf = new byte[STEPS];
            refined = new float[4 * STEPS];
            for (int i = 0; i < STEPS; i++) {
                binOf[i] = (byte) bin(i);
                for (int d = 0; d < 4; d++) refined[d * STEPS + i] = 0.5f * (refine[d * bins + binOf[i]] + CURVE[i]);
            }
            x = new float[contexts][BLOCK];
            rate = t.number("rate");
            step = (int) t.number("step");
        }

        static ByteBuffer part(RandomAccessFile file, FileChannel.MapMode mode, int k, int width, long entries) throws Exception {
            long from = ((long) k) << PART;
            return file.getChannel().map(mode, from * width, Math.min(1L << PART, entries - from) * width).order(ByteOrder.LITTLE_ENDIAN);
        }

        /** A symbol whose contexts are in now. */
        void push(int symbol, int to) {
            int size = length[symbol], from = start[symbol];
            if (n + size > BLOCK || symbols == BLOCK) flush();
            for (int k = 0; k < contexts; k++) context[k][symbols] = now[k];
            owner[symbols] = to;
            for (int d = 0; d < size; d++, n++) {
                if (d % levels == 0) {
                    node[heads] = nodes[from + d];
                    head[heads++] = symbols;
                }
                of[n] = symbols;
                line[n] = heads - 1;
                place[n] = places[from + d];
                bit[n] = bits[from + d];
                gate[n] = 16 * (d < 3 ? d : 3);
            }
            symbols++;
            pushed++;
        }

        void flush() {
            if (n > 0) {
                for (int k = 0; k < contexts; k++) {
                    begin(context[k], 0x9E3779B97F4A7C15L + 2 * k, 64 - sizes[k], base[k]);
                    if (pass == COUNT) count();
                    else look(x[k]);
                    if (pass != COUNT && k >= contexts - 3 && k != contexts - 2) gates(k == contexts - 1 ? 4 : 1);
                }
                if (pass == LEARN) learn();
                else if (pass == SCORE) score();
            }
            n = 0;
            symbols = 0;
            heads = 0;
        }

        /** The slot that each line's places are told from. */
        void begin(long[] c, long factor, int shift, long base) {
            for (int i = 0; i < heads; i++) first[i] = base + (((c[head[i]] + node[i]) * factor) >>> shift);
        }

        void count() {
            if (counts.length == 1) {
                IntBuffer t = counts[0];
                for (int j = 0; j < n; j++) {
                    int at = 2 * ((int) first[line[j]] ^ place[j]) + bit[j];
                    t.put(at, t.get(at) + 1);
                }
                return;
            }
            for (int j = 0; j < n; j++) {
                long cell = 2 * (first[line[j]] ^ place[j]) + bit[j];
                IntBuffer t = counts[(int) (cell >>> PART)];
                int at = (int) (cell & LESS);
                t.put(at, t.get(at) + 1);
            }
        }

        /** By 65536 * bit + code where bits are learned, as then their own count is taken out; else by code. */
        void look(float[] into) {
            int own = pass == LEARN ? 1 << 16 : 0;
            if (codes.length == 1) {
                ShortBuffer t = codes[0];
                for (int j = 0; j < n; j++) code[j] = (t.get((int) first[line[j]] ^ place[j]) & 0xFFFF) + own * bit[j];
            } else {
                for (int j = 0; j < n; j++) {
                    long slot = first[line[j]] ^ place[j];
                    code[j] = (codes[(int) (slot >>> PART)].get((int) (slot & LESS)) & 0xFFFF) + own * bit[j];
                }
            }
            for (int j = 0; j < n; j++) into[j] = stretched[code[j]];
        }

        void gates(int times) {
            for (int j = 0; j < n; j++) gate[j] += times * seen[code[j]];
        }

        /** To z: the mix within 12 of 0, in steps of the curve from -12. */
        void mix(int from, int to) {
            float[] w = used[0], v = x[0];
            for (int j = from; j < to; j++) z[j] = w[gate[j]] * v[j];
            for (int k = 1; k < contexts; k++) {
                w = used[k];
                v = x[k];
                for (int j = from; j < to; j++) z[j] += w[gate[j]] * v[j];
            }
            for (int j = from; j < to; j++) {
                float f = z[j];
                z[j] = ((f < -12f ? -12f : f > 12f ? 12f : f) + 12) * FINE;
            }
        }

        /** The map's bin that a step is in: of the bins' centres from -8 to 8, the nearest. */
        int bin(int step) {
            int width = 16 * FINE / (bins - 1), b = (step - 4 * FINE + width / 2) / width;
            return step < 4 * FINE ? 0 : b < bins ? b : bins - 1;
        }

        void learn() {
            for (int from = 0, to; from < n; from = to) {
                to = Math.min(n, from + step - done);
                mix(from, to);
                for (int j = from; j < to; j++) {
                    int step = (int) z[j], g = gate[j];
                    found[(g >> 4) * bins + binOf[step]] += (1L << 32) + bit[j];
                    saw[g]++;
                    z[j] = bit[j] - (CURVE[step] + (z[j] - step) * RISE[step]);
                }
                for (int k = 0; k < contexts; k++) add(x[k], moved[k], from, to);
                done += to - from;
                if (done == step) move();
            }
        }

        void add(float[] v, double[] into, int from, int to) {
            for (int j = from; j < to; j++) into[gate[j]] += z[j] * v[j];
        }

        void move() {
            for (int g = 0; g < GATES; g++) {
                double by = rate / Math.sqrt(Math.max(saw[g], 1));
                for (int k = 0; k < contexts; k++) {
                    weights[k][g] += by * moved[k][g];
                    used[k][g] = (float) weights[k][g];
                    moved[k][g] = 0;
                }
                gates[g] += saw[g];
                saw[g] = 0;
            }
            for (int c = 0; c < found.length; c++) {
                hits[c] += found[c] >>> 32;
                ones[c] += found[c] & 0xFFFFFFFFL;
                found[c] = 0;
            }
            done = 0;
        }

        /** Adds log10 probabilities to out of the symbols' owners. */
        void score() {
            mix(0, n);
            for (int j = 0; j < n; j++) {
                int step = (int) z[j];
                float p = refined[(gate[j] >> 4) * STEPS + step] + 0.5f * (z[j] - step) * RISE[step];
                p = (1 - bit[j]) + (2 * bit[j] - 1) * p;
                z[j] = p < 1e-7f ? 1e-7f : p > 1f ? 1f : p;
            }
            for (int j = 0; j < n;) {
                int s = of[j];
                double product = 1, sum = 0;
                for (; j < n && of[j] == s; j++) {
                    product *= z[j];
                    if (product < 1e-200) {
                        sum += Math.log10(product);
                        product = 1;
                    }
                }
                out[owner[s]] += sum + Math.log10(product);
            }
        }

        Row learned() {
            flush();
            if (done > 0) move();
            double[] w = new double[contexts * GATES];
            for (int k = 0; k < contexts; k++) System.arraycopy(weights[k], 0, w, k * GATES, GATES);
            return RowFactory.create(new Object[] {Integer.valueOf(number), packed(w), packed(gates), packed(hits), packed(ones)});
        }

        /** The counts of SLOTS slots: of those that aren't 0, with their cells, if that is shorter; null if all are 0. In as few bytes each as the largest needs. */
        Row counted(int block) {
            long from = 2L * SLOTS * block, to = Math.min(from + 2 * SLOTS, 2 * base[contexts]);
            int some = 0;
            int[] all = new int[2 * SLOTS];
            long most = 0;
            for (long cell = from; cell < to; cell++) {
                int c = counts[(int) (cell >>> PART)].get((int) (cell & LESS));
                all[(int) (cell - from)] = c;
                if (c != 0) some++;
                most = Math.max(most, c & 0xFFFFFFFFL);
            }
            if (some == 0) return null;
            int width = most < 1 << 8 ? 1 : most < 1 << 16 ? 2 : 4;
            boolean few = (2 + width) * some < width * 2 * SLOTS;
            ByteBuffer cells = ByteBuffer.allocate(few ? 2 * some : 0).order(ByteOrder.LITTLE_ENDIAN);
            ByteBuffer found = ByteBuffer.allocate(width * (few ? some : 2 * SLOTS)).order(ByteOrder.LITTLE_ENDIAN);
            for (int i = 0; i < all.length; i++) {
                if (few && all[i] == 0) continue;
                if (few) cells.putShort((short) i);
                if (width == 1) found.put((byte) all[i]);
                else if (width == 2) found.putShort((short) all[i]);
                else found.putInt(all[i]);
            }
            return RowFactory.create(new Object[] {Integer.valueOf(number), Integer.valueOf(block), cells.array(), found.array()});
        }

        long blocks() { return (base[contexts] + SLOTS - 1) / SLOTS; }
    }

    /** Tokens of texts, the contexts of each, and of spelled words' letters. */
    static class Reader {
        Model words, letters;
        byte[] vocabulary, low = new byte[1024];
        int[] ends, classes, table;
        double[] baseLog;
        boolean endKnown;
        int before, before2, frequent, frequent2, tokens, known, spelled;
        double base;
        long[] hashes = new long[16];

        Reader(BitCode t) throws Exception {
            words = new Model(t, 0, "words.");
            letters = new Model(t, 1, "letters.");
            vocabulary = (byte[]) t.given.get("vocabulary");
            ends = t.ints("ends");
            classes = t.ints("classes");
            baseLog = t.doubles("base_log");
            endKnown = t.number("texts") > 0;
            table = new int[Integer.highestOneBit(4 * Math.max(ends.length, 1))];
            for (int w = 0; w < ends.length; w++) {
                int from = w == 0 ? 0 : ends[w - 1];
                int at = place(vocabulary, from, ends[w]);
                while (table[at] != 0) at = (at + 1) & (table.length - 1);
                table[at] = w + 2;
            }
        }

        int place(byte[] b, int from, int to) {
            long h = to - from;
            for (int i = from; i < to; i++) h = (h ^ b[i]) * 0x100000001B3L;
            h ^= h >>> 29;
            return (int) (h * 0x9E3779B97F4A7C15L >>> 33) & (table.length - 1);
        }

        int id(int from, int to) {
            for (int at = place(low, from, to); table[at] != 0; at = (at + 1) & (table.length - 1)) {
                int w = table[at] - 2, first = w == 0 ? 0 : ends[w - 1];
                if (ends[w] - first != to - from) continue;
                int i = from;
                while (i < to && low[i] == vocabulary[first + i - from]) i++;
                if (i == to) return w + 2;
            }
            return SPELLED;
        }

        void token(int id) {
            long one = classes[before], two = classes[before2];
            long[] now = words.now;
            now[0] = 0;
            long h = hash(0, one);
            now[1] = h << 17;
            now[2] = hash(h, two) << 17;
            h = hash(0, before);
            now[3] = h << 17;
            now[4] = hash(hash(0, frequent), frequent2) << 17;
            now[5] = hash(h, before2) << 17;
            words.push(id, 0);
        }

        void letters(int from, int to, int word) {
            long whole = 0, power = 1;
            long[] now = letters.now;
            for (int i = from; i <= to; i++) {
                int at = i - from;
                long h = hash(0, Math.min(at, 12));
                now[0] = h << 17;
                h = 0;
                for (int k = 0; k < 4; k++) {
                    h = hash(h, at > k ? (low[i - k - 1] & 0xFF) + 2 : 0);
                    now[k + 1] = h << 17;
                }
                h = hash(hash(0, whole), Math.min(at, 12));
                now[5] = h << 17;
                now[6] = hash(h, before + 1) << 17;
                int letter = i < to ? (low[i] & 0xFF) + 1 : 0;
                letters.push(letter, word);
                whole += (letter + 7) * power;
                power *= 0x9E3779B97F4A7C15L;
            }
        }

        void read(byte[] text) {
            int n = text == null ? 0 : text.length;
            if (low.length < n) low = new byte[(int) Math.min(n + n / 2L, Integer.MAX_VALUE - 8)];
            for (int i = 0; i < n; i++) low[i] = text[i] >= 'A' && text[i] <= 'Z' ? (byte) (text[i] + 32) : text[i];
            before = before2 = frequent = frequent2 = END;
            tokens = known = spelled = 0;
            base = 0;
            for (int i = 0; i < n;) {
                if (low[i] == 32 || low[i] >= 9 && low[i] <= 13) {
                    i++;
                    continue;
                }
                int from = i;
                while (i < n && low[i] != 32 && (low[i] < 9 || low[i] > 13)) i++;
                int id = id(from, i);
                token(id);
                tokens++;
                if (id == SPELLED) {
                    if (words.pass == SCORE) {
                        if (spelled == hashes.length) {
                            hashes = java.util.Arrays.copyOf(hashes, 2 * spelled);
                            letters.out = java.util.Arrays.copyOf(letters.out, 2 * spelled);
                        }
                        hashes[spelled] = XXH64.hashUnsafeBytes(low, Platform.BYTE_ARRAY_OFFSET + from, i - from, 42L);
                        letters.out[spelled] = 0;
                    }
                    letters(from, i, spelled);
                    spelled++;
                } else {
                    known++;
                    base += baseLog[id];
                }
                before2 = before;
                before = id;
                int c = classes[id];
                if (c != SPELLED && c != MID) {
                    frequent2 = frequent;
                    frequent = c;
                }
            }
            token(END);
            tokens++;
            if (endKnown) known++;
            base += baseLog[END];
        }

        /** rid, doc_id, held_out, n_tokens, known, base, logp, size, rest */
        Row scored(long rid, Row row) {
            byte[] text = (byte[]) row.get(2);
            words.out[0] = 0;
            read(text);
            words.flush();
            letters.flush();
            Row[] rest = new Row[spelled];
            for (int k = 0; k < spelled; k++) rest[k] = RowFactory.create(new Object[] {Long.valueOf(hashes[k]), Double.valueOf(letters.out[k])});
            return RowFactory.create(new Object[] {Long.valueOf(rid), row.get(0), row.get(1), Long.valueOf(tokens), Long.valueOf(known), Double.valueOf(base), Double.valueOf(words.out[0]), Long.valueOf(text == null ? 0 : text.length), rest});
        }
    }

    static class Scored implements Iterator {
        Iterator rows;
        Reader reader;
        long rid;

        public boolean hasNext() { return rows.hasNext(); }

        public Object next() { return reader.scored(rid++, (Row) rows.next()); }

        public void remove() { throw new UnsupportedOperationException(); }
    }

    static class Counted implements Iterator {
        Model[] models;
        int model, block;
        Row ready;

        public boolean hasNext() {
            while (ready == null && model < models.length) {
                if (block < models[model].blocks()) ready = models[model].counted(block++);
                else {
                    model++;
                    block = 0;
                }
            }
            return ready != null;
        }

        public Object next() {
            hasNext();
            Row r = ready;
            ready = null;
            return r;
        }

        public void remove() { throw new UnsupportedOperationException(); }
    }

    public Iterator call(Iterator rows) throws Exception {
        if (!rows.hasNext()) return new ArrayList().iterator();
        Reader reader = new Reader(this);
        if (pass == SCORE) {
            Scored out = new Scored();
            out.rows = rows;
            out.reader = reader;
            out.rid = ((long) TaskContext.getPartitionId()) << 40;
            return out;
        }
        while (rows.hasNext()) reader.read((byte[]) ((Row) rows.next()).get(0));
        reader.words.flush();
        reader.letters.flush();
        if (pass == COUNT) {
            Counted out = new Counted();
            out.models = new Model[] {reader.words, reader.letters};
            return out;
        }
        ArrayList out = new ArrayList();
        if (reader.words.pushed > 0) out.add(reader.words.learned());
        if (reader.letters.pushed > 0) out.add(reader.letters.learned());
        return out.iterator();
    }
}
"""
COUNT, LEARN, SCORE = range(3)
_loaders: dict[str, object] = {}


def _new(spark: SparkSession):
    """An instance of the class, which is compiled and sent once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _loaders:
        jvm = sc._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(SOURCE)
        made = compiler.getBytecodes()
        jar = Path(tempfile.mkdtemp(prefix="chronoloom-")).resolve() / "chronoloom-bitcode.jar"
        with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as z:
            for name in made:
                z.writestr(name.replace(".", "/") + ".class", bytes(made[name]))
        sc._jsc.addJar(str(jar))
        _loaders[sc.applicationId] = compiler.getClassLoader()
    return _loaders[sc.applicationId].loadClass("chronoloom.BitCode").newInstance()


def over_texts(rows: DataFrame, which: int, arrays: dict[str, np.ndarray | bytes | str | float], schema: str) -> DataFrame:
    """One pass over rows of (text binary), or of (doc_id, held_out, text binary) for SCORE."""
    spark = rows.sparkSession
    task = _new(spark)
    task.choose(which)
    for name, x in arrays.items():
        task.put(name, x.tobytes() if isinstance(x, np.ndarray) else float(x) if isinstance(x, int) else x)
    jvm = spark.sparkContext._jvm
    encoder = jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.DataType.fromDDL(schema))
    return DataFrame(rows._jdf.mapPartitions(task, encoder), spark)
